"""Operator 1: secrets in whole texts, with a password guess-cost dynamic programme over credential values.

Base kinds are patterns: `assign` (a credential word, a separator, a value of 6 or more characters), `access` (access key
identifiers) and `hex` (long hexadecimal runs). The method adds kind `guess`: the value in a credential context (the base
words and further ones, such as pwd, passphrase, bearer or client_secret) if guessing it costs at least 10^`min_log10`
tries. The cost of a value is the cheapest way to cut it into dictionary words (with case and common substitutions),
dates, repeats, keyboard walks and brute-force spans, found by dynamic programming over its positions.

The dictionary is learnt: the most frequent plain words of all the documents, by their counts, after a fixed short list.
At most `MOST_WORDS` are kept and broadcast. So a word that texts use is cheap to guess, and a random string is not.

The work is linear in a text. A run of value characters is measured once; separators inside of a taken value are passed
over; the programme ends where every way to go on costs enough already.

Defined results: a null or empty text has no spans and gives a row of zeros; every row gives a row, repeated rows too;
texts and values are scanned whole, whatever their length; ties in start are put in the order of `KINDS`; columns other
than the id and the text are ignored. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

KINDS = ("assign", "access", "hex", "guess")

# Words that name a credential. The first five make base spans.
BASE_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
MORE_WORDS = ("pwd", "pass", "passphrase", "passcode", "credential", "credentials", "bearer", "auth", "pin", "private_key", "access_key", "secret_key", "client_secret", "privatekey", "accesskey", "secretkey")
#: Words of the learnt dictionary, at most, and what is counted: plain words between white space, in lower case, but no
#: values: what follows a separator teaches nothing, however often it is copied.
MOST_WORDS = 50_000
PLAIN_WORD = r"(?<![^ \t\n\x0B\f\r])(?<![:=][ \t\n\x0B\f\r]{1,4})(\p{Ll}{3,20})[.,;:!?]?(?![^ \t\n\x0B\f\r])"
# Words common in chosen passwords, by rank.
COMMON_WORDS = (
    "password", "qwerty", "admin", "welcome", "letmein", "login", "master", "monkey", "dragon", "football", "baseball", "iloveyou", "sunshine", "princess", "shadow", "superman",
    "batman", "trustno", "hello", "freedom", "whatever", "secret", "michael", "jordan", "summer", "winter", "spring", "autumn", "changeme", "default", "root", "test", "guest", "user",
    "example", "sample", "dummy", "token", "pass", "love", "money", "angel", "killer", "pepper", "cookie", "flower", "orange", "banana", "computer", "internet", "google", "access",
    "hunter", "ranger", "thomas", "robert", "charlie", "daniel", "jennifer", "george", "the", "and", "for", "you", "that", "with", "this", "have", "from", "your", "correct", "horse",
    "battery", "staple", "placeholder", "null", "none", "true", "false", "key", "value", "here", "insert", "abc", "xxx",
)
# Rows of a keyboard, each shifted by half a key against the one above.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
# Common substitutions.
LEET = str.maketrans("@4301!57$", "aaeoiists")

PLACE = {key: (row, col) for row, keys in enumerate(KEY_ROWS) for col, key in enumerate(keys)}
#: Keys next to a key, at most, and keys at which a walk can start.
NEIGHBOURS, STARTS = 6, len(PLACE)
STEPS = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
DATE = re.compile(r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}")
LOG_DATE, LOG_YEAR = math.log10(365 * 120), math.log10(120)
#: Longest unit of a repeat, and what each pattern span costs besides.
MOST_UNIT, SPAN = 8, 0.3
#: For each width of a unit the smaller ones that divide it.
PARTS = [[d for d in range(1, w) if w % d == 0] for w in range(MOST_UNIT + 1)]


class Words:
    """Dictionary words with their ranks."""

    def __init__(self, words):
        self.rank: dict[str, int] = {}
        for rank, word in enumerate(words, 1):
            self.rank.setdefault(word, rank)
        self.longest = max(map(len, self.rank), default=0)
        self.heads = {word[:3] for word in self.rank}

    def spans(self, value: str, plain: str, leet: str, i: int):
        """(end, log10 cost) of the words that begin at a place."""
        if plain[i : i + 3] not in self.heads and leet[i : i + 3] not in self.heads:
            return
        for j in range(i + 3, min(len(value), i + self.longest) + 1):
            direct = self.rank.get(plain[i:j])
            rank = direct or self.rank.get(leet[i:j])
            if rank:
                part = value[i:j]
                upper = sum(x.isupper() for x in part)
                variants = 1 if not upper else 2 if part.istitle() or part.isupper() else math.comb(j - i, upper)
                subs = 0 if direct else sum(a != b for a, b in zip(plain[i:j], leet[i:j]))
                yield j, math.log10(rank * variants * 2**subs)


COMMON = Words(COMMON_WORDS)


def direction(a: str, b: str) -> tuple[int, int] | None:
    """The step between two neighbouring keys."""
    a, b = a.lower().translate(SHIFTED), b.lower().translate(SHIFTED)
    if a not in PLACE or b not in PLACE:
        return None
    (r, c), (s, d) = PLACE[a], PLACE[b]
    return (s - r, d - c) if (s - r, d - c) in STEPS else None


def walks(value: str, i: int, enough: float = math.inf):
    """(end, log10 cost) of the keyboard walks of three keys or more that begin at a place, while they cost less."""
    turns, last = 0, None
    for k in range(i + 1, len(value)):
        step = direction(value[k - 1], value[k])
        if step is None:
            return
        turns, last = turns + (step != last), step
        cost = math.log10(STARTS) + math.log10(k + 1 - i) + turns * math.log10(NEIGHBOURS)
        if cost >= enough:
            return
        if k - i >= 2:
            yield k + 1, cost


def char_log(x: str) -> float:
    """log10 of the size of the class that a brute-force attack tries for a character."""
    return 1.0 if x.isdigit() else math.log10(26) if x.isascii() and x.isalpha() else math.log10(33) if x.isascii() else 2.0


def guess_cost(value: str, words: Words = COMMON, enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation of the whole value, or `enough` if that is not less.

    best[i] is the least cost of the first i characters. Words, dates and walks from i are put ahead to where they end. A
    repeat of a unit is taken where it ends: for each width and phase, the starts within the run of equal characters that
    can still give the least cost are kept, which are one or two.
    """
    n = len(value)
    plain = "".join(x if len(x) == 1 else "?" for x in map(str.lower, value))
    leet = plain.translate(LEET)
    best, sums, ahead = [0.0], [0.0], {}
    run, starts = [0] * (MOST_UNIT + 1), [{} for _ in range(MOST_UNIT + 1)]
    open_ = 0  # the last place that costs less than enough
    for i in range(n):
        if best[i] < enough:
            open_ = i
            ends = list(words.spans(value, plain, leet, i))
            if value[i].isdigit() and (m := DATE.match(value, i)):
                ends.append((m.end(), LOG_DATE if m.end() - i > 4 else LOG_YEAR))
            ends += walks(value, i, enough - best[i])
            for j, span in ends:
                cost = best[i] + max(span, 0.0) + SPAN
                if cost < min(enough, ahead.get(j, math.inf)):
                    ahead[j] = cost
        elif not ahead and i - open_ > 2 * MOST_UNIT:
            return enough
        end = i + 1
        sums.append(sums[i] + char_log(value[i]))
        cost = min(best[i] + sums[end] - sums[i], ahead.pop(end, math.inf))
        for w in range(1, min(MOST_UNIT, i) + 1):
            if value[i] != value[i - w]:
                if run[w]:
                    run[w] = 0
                    starts[w].clear()
                continue
            run[w] += 1
            if any(run[d] >= run[w] + w - d for d in PARTS[w]):
                continue  # the same run with a shorter unit costs less
            begin = end - w * max(2, -(-3 // w))
            phase = starts[w].setdefault(end % w, [])
            if begin >= end - run[w] - w and best[begin] < enough:
                log = lambda s: math.log10((end - s) // w)
                if all(best[s] + log(s) > best[begin] + log(begin) for s in phase):
                    phase[:] = [s for s in phase if best[s] < best[begin]] + [begin]
            if phase:
                unit = sums[end] - sums[end - w]
                cost = min(cost, SPAN + unit + min(best[s] + math.log10((end - s) // w) for s in phase))
        best.append(cost)
    return min(best[n], enough)


def either_case(word: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in word)


#: A separator with what follows it; credential words are looked up backwards from it.
SEPARATOR = re.compile("[:=]")
BASE_BEFORE = re.compile(f"({'|'.join(map(either_case, BASE_WORDS))})[\"']?\\Z")
MORE_BEFORE = re.compile(f"(?<![A-Za-z])({'|'.join(map(either_case, (*BASE_WORDS, *MORE_WORDS)))})[\"']?\\Z")
BASE_VALUE = re.compile("\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
MORE_HEAD = re.compile("[=>]?\\x20*[\"']?")
MORE_VALUE = re.compile("[^\\s\"'`,;<>(){}\\[\\]]+")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LONGEST_BEFORE = 2 + max(map(len, (*BASE_WORDS, *MORE_WORDS)))


def scan(text: str | None, words: Words = COMMON, min_log10: float = 8.0, least: int = 6) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start and kind."""
    text = text or ""
    spans: list[tuple[int, str, int]] = []
    taken = guessed = 0  # ends of the last assignment and of the last guess
    run = (0, 0)  # the last run of value characters
    for sep in SEPARATOR.finditer(text):
        at = sep.start()
        stop = at
        while stop and text[stop - 1] == " ":
            stop -= 1
        low = max(0, stop - LONGEST_BEFORE)
        word = BASE_BEFORE.search(text, low, stop)
        if word and word.start() >= taken and (value := BASE_VALUE.match(text, at + 1)):
            taken = value.end()
            if taken - value.start(1) >= 6:
                spans.append((word.start(), "assign", taken))
        if word or MORE_BEFORE.search(text, low, stop):
            start = MORE_HEAD.match(text, at + 1).end()
            if start < guessed:
                continue
            if not run[0] <= start < run[1]:
                run = found.span() if (found := MORE_VALUE.match(text, start)) else (start, start)
            if run[1] - start >= least and guess_cost(text[start : run[1]].rstrip(".:!?"), words, min_log10) >= min_log10:
                guessed = run[1]
                spans.append((start, "guess", guessed))
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def learnt_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> Words:
    """The fixed words, then the most frequent plain words of all rows; ties by the word."""
    every = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(PLAIN_WORD), F.lit(1))).alias("word"))
    top = every.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()
    return Words([*COMMON_WORDS, *(r["word"] for r in top)])


def secret_spans(docs: DataFrame, min_log10: float = 8.0, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """Per document the counts of base spans, the digest of the base spans, and all spans."""
    words = docs.sparkSession.sparkContext.broadcast(learnt_words(docs, text_col, most_words))

    def rows(columns):
        for doc_id, text in zip(*columns):
            spans = scan(text, words.value, min_log10)
            base = [s for s in spans if s[1] != "guess"]
            counts = [sum(s[1] == kind for s in spans) for kind in KINDS]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return map_rows(docs.select(id_col, text_col), rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
