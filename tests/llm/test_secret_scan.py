import hashlib
import math
import random
import re
import time

import pytest

from strandloom.llm import secret_scan as S

from ..helpers import rows_by


def brute(text):
    """The base spans by plain patterns."""
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    word += "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(f"({word})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


PARTS = ["password", "PassWord", "secret", "token", "api_key", "apikey", "passwd", "pwd", "=", ":", " ", "  ", '"', "'", "abc123", "0a1b2c3d", "=", "AKIA", "ABCDEFGH12345678", "é", "\n", "x", "-", ".", "deadbeef" * 3]


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(7)
    for _ in range(6000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 30)))
        assert S.joined([s for s in S.scan(text) if s[1] != "guess"]) == brute(text), text


def test_base_spans_on_documents(docs_001):
    for text in docs_001:
        assert S.joined([s for s in S.scan(text) if s[1] != "guess"]) == brute(text)


def exhaustive(value):
    """The least cost over all segmentations: all words, dates, repeats and walks from all starts, tried one by one."""
    plain = value.lower()

    def spans(i):
        yield from S.COMMON.spans(value, plain, plain.translate(S.LEET), i)
        yield from S.walks(value, i)
        if m := S.DATE.match(value, i):
            yield m.end(), S.LOG_DATE if m.end() - i > 4 else S.LOG_YEAR
        for w in range(1, S.MOST_UNIT + 1):
            t = 2
            while value[i : i + w * t] == value[i : i + w] * t and i + w * t <= len(value):
                if w * t >= 3:
                    yield i + w * t, sum(map(S.char_log, value[i : i + w])) + math.log10(t)
                t += 1

    best = {len(value): 0.0}
    for i in reversed(range(len(value))):
        best[i] = min([S.char_log(value[i]) + best[i + 1], *(max(c, 0.0) + S.SPAN + best[j] for j, c in spans(i))])
    return best[0]


def test_guess_cost_is_least_over_segmentations():
    rnd = random.Random(3)
    parts = ["pass", "p@ss", "password", "fghjkl", "qwe", "1999", "20200131", "aaa", "a", "x", "Z9", "!", "asdf", "abab", "é"]
    for _ in range(1500):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7)))
        if rnd.random() < 0.3:
            value *= rnd.randrange(1, 5)
        truth = exhaustive(value)
        assert abs(S.guess_cost(value) - truth) < 1e-9, value
        assert abs(S.guess_cost(value, enough=8.0) - min(truth, 8.0)) < 1e-9, value


def test_walk_that_touches_a_word():
    assert S.guess_cost("passwordfghjkl") < 4.5 and S.guess_cost("passwordddddd") < 4


def cpu_seconds(call):
    """The least of two runs, in the CPU time of this process: other programs do not count."""
    best = float("inf")
    for _ in range(2):
        began = time.process_time()
        call()
        best = min(best, time.process_time() - began)
    return best


@pytest.mark.parametrize("text", ["token=" * 20_000, "pin:" * 20_000, "pin: " * 20_000, "pin:a" * 20_000, "pin:" + "a" * 50_000, "pin:" + "pin:aaaaaaa" * 20_000, "auth=" + "as" * 25_000, "token " + "=" * 50_000, "secret:" * 9 + "0" * 50_000])
def test_linear_on_hostile_texts(text):
    """Four times the text takes about four times as long; quadratic work would take sixteen times."""
    short, long = (cpu_seconds(lambda: S.scan(text[:n])) for n in (len(text) // 4, len(text)))
    assert long < 10 * short + 0.1


def test_words_of_the_documents_are_no_secrets(spark):
    plain = ["disabled", "number", "something", "required", "überprüfung"]
    texts = ["the door is {0}. A {0} was seen, {0} again".format(w) for w in plain] * 3
    values = [f"auth: {w}" for w in plain] + ["auth: disabled.", "pin: Required", "auth: xkqzvbnwjt", "pin: Q7#kd9!xW2"]
    docs = spark.createDataFrame(list(enumerate(values + texts)), "doc_id bigint, text string")
    out = rows_by(S.secret_spans(docs), "doc_id")
    assert [out[k][0].n_guess for k in range(len(values))] == [0] * 7 + [1, 1]


def test_guess_cost_order():
    assert S.guess_cost("password") < S.guess_cost("P@ssword1999") < S.guess_cost("b7db7aa4a5fcc78305")
    assert S.guess_cost("aaaaaaaaaaaaaaaa") < 4 and S.guess_cost("qwertyuiop") < 5 and S.guess_cost("") == 0


def test_guess_spans():
    assert "guess:4:20" in S.joined(S.scan("pwd=Zk3!vq9#Tx8$wb2@"))
    assert not [s for s in S.scan("pwd=aaaaaaaaaa and pin: 1999") if s[1] == "guess"]
    assert not [s for s in S.scan("compass=Zk3!vq9#Tx8$wb2@") if s[1] == "guess"]


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "token = abcdef", 7), (2, "", 6), (3, "a" * 300_000, 0)], "doc_id bigint, text string, spans int")
    out = rows_by(S.secret_spans(df), "doc_id")
    assert len(out[2]) == 2 and out[1][0].n_assign == 0 and out[1][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None][0].spans == "assign:0:14" and out[3][0].n_hex == 1
    assert S.secret_spans(df.limit(0)).count() == 0
