"""Operator 10: personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds the anchors: at-signs, plus signs, digits, address schemes and cues of
identifiers. From each anchor a deterministic local parser expands to the boundaries of an email address, an IP address,
a card or phone number, an address with a scheme, or an account number, and validates it (octets, digits, Luhn, IBAN
check digits). Kinds email, ip, card and phone are the base; `url` (mailto: and addresses that carry a user or an IP
host) and `account` (an identifier after its cue) are what the anchors add.

Defined results: a null or empty text has no spans and gives a row of zeros; every row gives a row, repeated rows too;
texts are scanned whole, in time linear in their length; a span that fails validation is dropped without another try, but an account number is tried
from its longest to its shortest sequence of groups, as an IBAN first; columns other than the id and the text are ignored.
Offsets are in code points, ends exclusive. The case (A-Z) of cues, what follows them, and schemes does not matter.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

# Schemes and identifier cues.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "customer id", "user id", "member id", "routing", "konto", "compte", "cuenta")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"[A-Za-z0-9._~:/?#@!$&*+,;=%\[\]-]+")
HOST_IP = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z.])")
CUE_TAIL = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id|code|#))?\x20?(?:[:=#]\x20?|\x20is\x20)?", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:-[A-Z0-9]{2,6})*")
IBAN_GROUP = re.compile(r"[\x20-]?[A-Z0-9]{1,34}(?![A-Za-z0-9])")
DIGIT_GROUP = re.compile(r"[\x20-][0-9]{1,30}(?![A-Za-z0-9_@%]|[.,:/][0-9])")
IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
NO_DIGIT = re.compile("[^0-9]")
ASCII_LOWER = {k: k + 32 for k in range(65, 91)}
#: Least and most characters of an IBAN, and most digits of another account number of several groups.
LEAST_IBAN, MOST_IBAN, MOST_DIGITS = 15, 34, 30


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for sign in "@+0123456789":
        a.add_word(sign, (sign if sign in "@+" else "0", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    flat = re.sub("[ -]", "", text)
    return bool(IBAN.fullmatch(flat)) and int("".join(str(int(x, 36)) for x in flat[4:] + flat[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return NO_DIGIT.sub("", text)


def emails(text: str, anchors: list[int]):
    """Expand left over the local part, not beyond the last address, and right over the domain."""
    end = 0
    for at in anchors:
        if at < end:
            continue
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, (end := domain.end())


def run_starts(places: list[int]) -> list[int]:
    """The first of each run of consecutive digits."""
    return [p for k, p in enumerate(places) if not k or places[k - 1] != p - 1]


def ips(text: str, starts: list[int]):
    end = 0
    for at in starts:
        if at >= end and (m := OCTETS.match(text, at)):
            end = m.end()
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                yield at, end


def cards(text: str, starts: list[int]):
    end = 0
    for at in starts:
        if at >= end and (m := CARD.match(text, at)):
            end = m.end()
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield at, end


def phones(text: str, anchors: list[int]):
    for at in anchors:
        if (m := PHONE.match(text, at)) and 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def urls(text: str, anchors: list[tuple[int, int]]):
    """Expand right over the run of address characters, which is measured once however many anchors are in it."""
    end, run, last = 0, (0, 0), 0
    for at, length in anchors:
        if at < end or at and text[at - 1].isalnum():
            continue
        start = at + length
        if not run[0] <= start < run[1]:
            m = ADDRESS.match(text, start)
            if not m:
                continue
            run, last = m.span(), start + len(m[0].rstrip(".,;:!?*"))
        stop = max(start, last)
        slash = text.find("/", start, stop)
        at_sign = text.find("@", start, stop if slash < 0 else slash)
        if text[at] in "mM" or at_sign >= 0 or HOST_IP.match(text, start):
            yield at, (end := stop)


def group_ends(text: str, start: int, end: int, group: re.Pattern, most: int) -> list[int]:
    """`end` and the ends of the groups that follow it, while they have at most so many letters and digits from `start`,
    where an identifier, of these and hyphens, starts."""
    ends, size = [end], end - start - text.count("-", start, end)
    while (m := group.match(text, ends[-1])) and (size := size + len(m[0].lstrip(" -"))) <= most:
        ends.append(m.end())
    return ends


def accounts(text: str, low: str, anchors: list[tuple[int, int]]):
    end = 0
    for at, length in anchors:
        if at < end or at and text[at - 1].isalnum():
            continue
        tail = CUE_TAIL.match(low, at + length)
        m = IDENTIFIER.match(text, tail.end()) if tail.end() > at + length else None
        if m:
            start = m.start()
            stop = None
            if IBAN_HEAD.match(text, start):
                groups = group_ends(text, start, start, IBAN_GROUP, MOST_IBAN)
                stop = next((e for e in reversed(groups) if e - start >= LEAST_IBAN and iban(text[start:e])), None)
            if not stop:
                groups = group_ends(text, start, m.end(), DIGIT_GROUP, MOST_DIGITS)
                if len(digits_of(text[start : groups[-1]])) >= 6:  # else no shorter prefix has six
                    stop = next(e for e in reversed(groups) if len(digits_of(text[start:e])) >= 6)
            if stop:
                end = stop
                yield start, stop


def scan(text: str | None, finder: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of KINDS, then start."""
    text = text or ""
    at: dict[str, list] = {"@": [], "+": [], "0": [], "scheme": [], "cue": []}
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)  # the offsets stay
    for last, (kind, length) in finder.iter(low):
        at[kind].append(last if length == 1 else (last + 1 - length, length))
    for kind in ("scheme", "cue"):  # an anchor in a longer one at the same place gives way
        best = {}
        for start, length in at[kind]:
            best[start] = max(best.get(start, 0), length)
        at[kind] = sorted(best.items())
    starts = run_starts(at["0"])
    found = {"email": emails(text, at["@"]), "ip": ips(text, starts), "card": cards(text, starts), "phone": phones(text, at["+"]), "url": urls(text, at["scheme"]), "account": accounts(text, low, at["cue"])}
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of the kinds, the digest of the base spans, and all spans."""
    finders: list[ahocorasick.Automaton] = []

    def rows(columns):
        if not finders:
            finders.append(automaton())
        for doc_id, text in zip(*columns):
            spans = scan(text, finders[0])
            base = joined([s for s in spans if s[0] in BASE])
            counts = [sum(s[0] == kind for s in spans) for kind in KINDS]
            yield (doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans))

    counts = "".join(f"n_{kind} bigint, " for kind in KINDS)
    return map_rows(docs.select(id_col, text_col), rows, f"doc_id bigint, {counts}base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def mask_personal(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` with personal data in the text replaced by its kind; null texts stay null.

    All columns are kept; `chars_col`, where `docs` has it, is set anew for the rows whose text changes."""
    from pyspark.sql import functions as F

    finders: list[ahocorasick.Automaton] = []

    @F.pandas_udf("string")
    def mask(texts):
        if not finders:
            finders.append(automaton())
        return texts.map(lambda t: t if t is None else masked(t, scan(t, finders[0])))

    columns = docs.columns
    out = docs.withColumn(text_col, mask(F.col(text_col)))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents"))
