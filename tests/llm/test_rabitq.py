import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import rabitq as R

from ..helpers import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, k=5):
    """Exact neighbours by cosine of all rows, ties to the smaller id."""
    ids, vectors = np.array([r[0] for r in rows]), np.array([np.float32(r[1]) for r in rows], dtype=np.float64)
    norms = np.sqrt((vectors**2).sum(1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (vectors * vectors[i]).sum(1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def search(spark, rows, k=5):
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], SCHEMA)
    out = {}
    for r in R.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall_and_scores(spark, spread):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 32))
    rows = [(i, [float(x) for x in np.float32(base[i % 20] + spread * rng.standard_normal(32))]) for i in range(3000)]
    truth, found = brute(rows), search(spark, rows)
    assert truth.keys() == found.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len({a for a, _ in truth[q]} & {a for a, _ in found[q]}) / 5 for q in truth]) >= 0.9
    exact = {(q, a): s for q, v in brute(rows, 3000).items() for a, s in v}
    assert all(exact[q, a] == pytest.approx(s, abs=1e-12) for q, v in found.items() for a, s in v)


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 else [float(i % 7), 1.0, -0.5]) for i in range(400)]
    assert {q: [a for a, _ in v] for q, v in search(spark, rows).items()} == {q: [a for a, _ in v] for q, v in brute(rows).items()}


def test_short_lists_are_made_up_for(spark, monkeypatch):
    """Outliers alone in their lists, with one list probed, still get k neighbours; doubles keep their precision."""
    monkeypatch.setattr(R.Index, "fitted", lambda self, sample, k: 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * 0.05 + (np.eye(16)[0] if i % 40 else np.eye(16)[1 + i // 40 % 15])]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = R.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    counts = {q: sum(r.query_id == q for r in out) for q in range(0, 1200, 50)}
    assert set(counts.values()) == {5}
    v = np.array([x for _, x in rows])
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    assert all(r.score == pytest.approx(v[r.query_id] @ v[r.vec_id], abs=1e-13) for r in out)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = R.unit(rng.standard_normal((2000, 64)))
    index = R.Index(rows, 2000, 5)
    own = index.nearest(rows)
    for c in set(own.tolist()):
        part = rows[own == c]
        low, high = index.bounds(rows[:50], c, *index.codes(part, np.full(len(part), c)))
        truth = rows[:50] @ part.T
        assert ((low <= truth) & (truth <= high)).mean() > 0.99


def test_fixture(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {q: [a for a, _ in v] for q, v in search(spark, rows).items()} == {q: [a for a, _ in v] for q, v in brute(rows).items()}


def test_edge_rows(spark):
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [1.0, 0.1])]
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (200, [1.0, 2.0, 3.0])]
    out = search(spark, good + bad)
    assert list(out) == [0] and [a for a, _ in out[0]] == [1, 2]
    assert search(spark, [(0, [1.0, 1.0])]) == {}
    assert R.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
