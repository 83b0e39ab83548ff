import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import lm_score as M

from ..helpers import SF

SCHEMA = "doc_id bigint, text string, score int"


def words(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall("[^\\x20\\x09-\\x0D]+", text), None]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


def quantised(c):
    if not c:
        return 0.0
    level = 1 + math.floor(math.log(c) / math.log(M.BASE) + 1e-9)
    low = math.ceil(M.BASE ** (level - 1) - 1e-9)
    return math.sqrt(low * max(low, math.ceil(M.BASE**level - 1e-9) - 1))


def brute(docs):
    one, two = Counter(), Counter()
    for doc_id, text in docs:
        if not held(doc_id):
            w = words(text)
            one.update(w)
            two.update(zip(["<s>", *w], w))
    n, v = sum(one.values()), len(one)
    q1, q2 = {k: quantised(c) for k, c in one.items()}, {k: quantised(c) for k, c in two.items()}
    out = []
    for doc_id, text in docs:
        w = words(text)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            context, word = q1.get(None, 0.0) if a == "<s>" else q1.get(a, 0.0), q1.get(b, 0.0)
            score += math.log10((min(q2.get((a, b), 0.0), context, word) + M.MU * (word + 1) / (n + v + 1)) / (context + M.MU))
        out.append((doc_id, held(doc_id), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def run(spark, docs, **more):
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], SCHEMA)
    out = M.lm_scores(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2, **more)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    return sorted(map(tuple, out.collect()), key=key), sorted(brute(docs), key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("most_heavy", [10**6, 50])
def test_filter_on_documents(spark, docs, most_heavy):
    found, truth = run(spark, docs, most_heavy=most_heavy)
    for a, b in zip(found, truth, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=0.03, abs=0.5)


@pytest.mark.parametrize("clearly", [1, 10**9])
def test_same_scores_on_both_sides_of_the_bound(spark, docs, monkeypatch, clearly):
    monkeypatch.setattr(M, "SEGMENT", 20_000)
    monkeypatch.setattr(M, "BLOCK_BYTES", 100_000, raising=False)
    monkeypatch.setattr(M, "CLEARLY", clearly, raising=False)
    docs = docs + [(None, "a b"), (10**7, None), (10**7, None)]
    below, _ = run(spark, docs, most_filter_bytes=1 << 40, most_heavy=50)
    beyond, _ = run(spark, docs, most_filter_bytes=1, most_heavy=50)
    for a, b in zip(below, beyond, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_segments_are_sized_on_all_texts(spark, monkeypatch):
    """Short texts first, long ones last: segments are as many as all words ask for, and a word of all texts is no hot key."""
    sent = []
    monkeypatch.setattr(M, "SEGMENT", 5000)
    monkeypatch.setattr(M, "BLOCK_BYTES", 50_000)
    real = M.counted_blocks
    monkeypatch.setattr(M, "counted_blocks", lambda blocks, power: sent.append((blocks.count(), power)) or real(blocks, power))
    docs = [(k, "a") for k in range(3000)] + [(k, " ".join(f"the w{(k * 7 + j) % 5000}" for j in range(400))) for k in range(3000, 3100)]
    beyond, truth = run(spark, docs, most_filter_bytes=1, most_heavy=50)
    blocks, power = sent[0]
    assert blocks > 4 and 2 ** power * 5000 >= 2 * sum(t[2] for t in truth) > 2 ** (power - 1) * 5000
    below, _ = run(spark, docs, most_heavy=50)
    for a, b, c in zip(below, beyond, truth, strict=True):
        assert a[:5] == b[:5] == c[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_many_segments_cost_few_rows(spark, docs, monkeypatch):
    """With far more segments than groups a block sends a row to each group at most, batches put several blocks' n-grams of a
    segment together, and scores stay as they are."""
    seen = {}
    for name, value in (("SEGMENT", 40), ("GROUPS_POWER", 3), ("BATCH_BLOCKS", 2)):
        monkeypatch.setattr(M, name, value)
    sent, batched = M.sent_blocks, M.batched
    monkeypatch.setattr(M, "sent_blocks", lambda blocks, groups: seen.setdefault("sent", (sent(blocks, groups), groups, blocks.count()))[0])
    monkeypatch.setattr(M, "batched", lambda rows, power, slots: seen.setdefault("batched", (batched(rows, power, slots), power, slots))[0])
    beyond, _ = run(spark, docs[:120], most_filter_bytes=1, most_heavy=50)
    rows, groups, blocks = seen["sent"]
    batches, power, slots = seen["batched"]
    assert groups == 3 and power > 8 and slots == -(-blocks // 2) >= 2
    assert rows.count() <= 2**groups * blocks and rows.groupBy("block").count().agg({"count": "max"}).first()[0] <= 2**groups
    assert batches.where("block IS NOT NULL").count() == rows.count()
    monkeypatch.undo()
    below, _ = run(spark, docs[:120], most_heavy=50)
    for a, b in zip(below, beyond, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and b[6] == pytest.approx(a[6], rel=0.03, abs=0.5)


def test_filter_has_all_levels_and_few_others():
    rng = np.random.default_rng(0)
    np.seterr(over="ignore")
    grams = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2))
    level = M.levels(np.minimum(rng.zipf(1.5, len(grams)), 10**6))
    f = M.Filter({k: M.filter_of(grams[M.segment_of(grams, 2) == k], level[M.segment_of(grams, 2) == k]).tobytes() for k in range(4)}, 2)
    got = f.levels(grams)
    assert (got >= level).all() and (got > level).mean() < 0.05
    assert (f.levels(rng.integers(0, 2**63, 40_000).astype(np.uint64) | np.uint64(1)) > 0).mean() < 0.05


def test_segments_do_not_change_results(spark, docs, monkeypatch):
    whole, _ = run(spark, docs[:80])
    monkeypatch.setattr(M, "SEGMENT", 2000)
    cut, truth = run(spark, docs[:80])
    for a, b, c in zip(whole, cut, truth, strict=True):
        assert a[:5] == b[:5] == c[:5] and b[6] == pytest.approx(c[6], rel=0.03, abs=0.5)


def test_copies_of_training_texts_score_better(spark, docs):
    text = max((t for k, t in docs if not held(k)), key=len)
    other = " ".join(sorted(text.split()))
    found, _ = run(spark, docs + [(k, t) for k, t in zip([x for x in range(10**6, 10**6 + 60) if held(x)], [text, other])])
    a, b = sorted(r[6] for r in found if r[0] >= 10**6)
    assert b > a + 100


def test_edge_rows(spark):
    edge = [(1, None), (2, ""), (None, "a  B\x0bc d"), (None, "a  B\x0bc d"), (2, ""), (3, "x " * 200_000)]
    found, truth = run(spark, edge)
    assert [a[:5] for a in found] == [b[:5] for b in truth] and [a[5] for a in found] == pytest.approx([b[5] for b in truth])
    only = [(k, "a b") for k in range(100) if held(k)][:2]
    found, truth = run(spark, only)
    assert [a[:5] for a in found] == [b[:5] for b in truth] and found[0][4] == 0
    assert run(spark, []) == ([], [])
