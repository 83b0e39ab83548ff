"""Searches score documents where they are read: against a plain version, and without shuffles of pairs or of texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import catalog
from strandloom.operators import retrieval
from strandloom.operators.search_index import IndexStore
from strandloom.sources.store import names

from .helpers import SF

WORDS = "apple pear plum fig grape quince sloe".split()


def plain(docs, asked, k):
    out = {}
    for q in {a[0] for a in asked}:
        scored = []
        for doc_id, text in docs:
            tf = Counter(text.split())
            s = retrieval.rounded(np.array([sum(w * tf[t] / len(text.split()) for x, t, w in asked if x == q and tf[t])]))[0]
            scored += [(-s, doc_id)] if s > 0 else []
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def cases(seed):
    rnd = random.Random(seed)
    docs = [(n, " ".join(rnd.choices(WORDS, k=rnd.choice((1, 2, 3, 8))))) for n in range(90)]
    return docs, [(q, t, rnd.choice((0.5, 1.0, 2.0))) for q in range(7) for t in rnd.sample(WORDS, rnd.randrange(1, 5))]


@pytest.mark.parametrize("portion", [1, 20, 10**6])
def test_portions_of_a_task(monkeypatch, portion):
    monkeypatch.setattr(retrieval, "PORTION", portion)
    docs, asked = cases(1)
    table = pa.table(dict(zip(("query_id", "term", "weight"), map(list, zip(*asked)))))
    scorer = retrieval.Scorer(table, 4, lambda tf, dl: tf / dl, pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]))
    rows = [{"doc_id": d, "dl": len(t.split()), "terms": [{"term": w, "tf": n} for w, n in Counter(t.split()).items()]} for d, t in docs]
    kind = pa.schema([("doc_id", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))])
    found = {}
    for batch in scorer.best(iter([pa.RecordBatch.from_pylist(rows[:50], kind), pa.RecordBatch.from_pylist(rows[50:], kind)])):
        for r in batch.to_pylist():
            found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert found == plain(docs, asked, 4)


def test_blocks_of_queries_and_no_rows_of_pairs(spark, monkeypatch):
    docs, asked = cases(2)
    index = retrieval.SearchIndex.build(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    frame = spark.createDataFrame(asked, "query_id bigint, term string, weight double")
    for most in (10**6, 5):
        monkeypatch.setattr(retrieval, "MOST_ASKED", most)
        hits = index.best(frame, 4, lambda tf, dl: tf / dl)
        assert not any(x in hits._jdf.queryExecution().toString() for x in ("Aggregate", "SortMergeJoin", "Exchange"))
        found = {}
        for r in sorted(hits.collect(), key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert found == plain(docs, asked, 4)


def test_rounds_as_spark(spark):
    values = [5 / 128, 1 / 3, 2.5e-7, 5e-7, 0.0000015, 12.3456785, 1.0, 39062.4999995]
    assert list(retrieval.rounded(np.array(values))) == [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]


def test_rows_of_one_id_are_one_document(spark):
    index = retrieval.SearchIndex.build(spark.createDataFrame([(1, "fig plum"), (1, "fig"), (None, "sloe"), (2, "kiwi"), (3, "pear"), (4, "lime")], "doc_id bigint, text string"))
    assert sorted((r.term, r.df, r.total) for r in index.terms.where("term IN ('fig', 'sloe')").collect()) == [("fig", 1, 2), ("sloe", 1, 1)]
    asked = spark.createDataFrame([(1, "fig sloe")], "item_id int, text string")
    assert sorted(str(r.doc_id) for r in retrieval.bm25_search(index, asked, 5).collect()) == ["1", "None"]


def test_a_kept_index_holds_no_texts_and_each_posting_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.apply(spark.createDataFrame([(1, "apple fig"), (2, "plum")], "doc_id bigint, text string"))
    store.apply(spark.createDataFrame([(1, "pear")], "doc_id bigint, text string"))
    assert all(set(names(spark, f"{tmp_path}/segments/{s}")) == {"docs", "dead", "terms"} for s in names(spark, f"{tmp_path}/segments"))
    assert sorted((r.doc_id, r.term) for r in store.live("postings").collect()) == [(1, "pear"), (2, "plum")]


@pytest.mark.parametrize("name", ["decomposed_search", "evaluation_dedup", "metrics_by_config", "best_retrieval", "hybrid_filtered", "sub_query_union", "answers_by_config"])
def test_texts_are_not_shuffled_to_hits(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [doc_id" not in plan
