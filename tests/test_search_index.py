"""An index that is kept up equals one built anew over what is left."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import retrieval
from strandloom.operators.search_index import IndexStore
from strandloom.sources.store import names
from strandloom.streaming.ingest import SCHEMA, index_at, ingest_stream

DDL = "doc_id bigint, text string, deleted boolean, version bigint"
WORDS = "apple pear plum fig grape quince sloe".split()


def figures(index):
    return (index.n_docs, round(index.mean_length, 9), round(index.mean_idf, 9), sorted(map(tuple, index.weighted_terms().select("term", "df", "total").collect())))


def found(spark, index):
    asked = spark.createDataFrame([(1, "apple fig"), (2, "plum plum quince"), (3, "none")], "item_id int, text string")
    return sorted(map(tuple, retrieval.bm25_search(index, asked, 50).select("query_id", "doc_id", "score", "rank").collect()))


def same_as_rebuilt(spark, store, left):
    built = retrieval.SearchIndex.build(spark.createDataFrame(list(left.items()), "doc_id bigint, text string"))
    assert figures(store.open()) == figures(built) and found(spark, store.open()) == found(spark, built)
    assert sorted(r.doc_id for r in store.live("docs").collect()) == sorted(left)


def batches(seed, n=7):
    rnd = random.Random(seed)
    for k in range(n):
        yield [(rnd.randrange(40), " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 9))), rnd.random() < 0.25, None) for _ in range(rnd.choice((1, 3, 25)))]


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    store, left = IndexStore(spark, str(tmp_path)), {}
    for k, rows in enumerate(batches(3)):
        rows = list({r[0]: r for r in rows}.values())
        assert store.apply(spark.createDataFrame(rows, DDL), "s", k) and not store.apply(spark.createDataFrame(rows, DDL), "s", k)
        for doc_id, text, deleted, _ in rows:
            left.pop(doc_id, None)
            if not deleted:
                left[doc_id] = text
    same_as_rebuilt(spark, store, left)
    m = store.manifest()
    assert len(m["segments"]) < 7 and all(m["docs"][str(a)] >= 2 * m["docs"][str(b)] for a, b in zip(m["segments"], m["segments"][1:]))
    store.merge(whole=True)
    store.vacuum()
    assert len(store.manifest()["segments"]) == 1 == len(names(spark, f"{tmp_path}/segments")) and store.stored(store.manifest()["segments"], "dead").count() == 0
    same_as_rebuilt(spark, store, left)


def test_edge_rows(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    assert figures(store.open())[:2] == (0, 0.0) and found(spark, store.open()) == []
    store.apply(spark.createDataFrame([(None, "apple", None, 1), (1, "fig", False, 1), (1, "plum", None, 2), (2, None, None, None), (3, "pear", True, 5), (3, "sloe", None, 4), (4, "a", None, None), (4, "b", None, None)], DDL))
    same_as_rebuilt(spark, store, {1: "plum", 2: "", 4: "b"})
    store.apply(spark.createDataFrame([], DDL))
    store.apply(spark.createDataFrame([(99, "gone", True, None), (1, "plum", None, None)], DDL))
    same_as_rebuilt(spark, store, {1: "plum", 2: "", 4: "b"})
    store.apply(spark.createDataFrame([(k, None, True, None) for k in (1, 2, 4)], DDL))
    assert figures(store.open()) == (0, 0.0, 0.0, [])


def test_a_batch_that_failed_half_way_is_written_again(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path))
    store.apply(spark.createDataFrame([(1, "apple", None, None)], DDL), "s", 0)
    monkeypatch.setattr(store, "save", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.apply(spark.createDataFrame([(1, "fig", None, None), (2, "fig", None, None)], DDL), "s", 1)
    monkeypatch.undo()
    same_as_rebuilt(spark, store, {1: "apple"})
    assert store.apply(spark.createDataFrame([(1, "fig", None, None), (2, "fig", None, None)], DDL), "s", 1)
    same_as_rebuilt(spark, store, {1: "fig", 2: "fig"})
    m = store.manifest()
    m["version"] -= 1
    with pytest.raises(FileExistsError):
        store.save(m)  # of two writers one commits


def test_stream_of_insertions_changes_and_deletions(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    left = {}
    for rows in ([(1, "apple fig."), (2, "plum."), (3, "quince.")], [(2, "pear fig."), (4, "sloe.")], [(1, None), (3, "apple apple.")]):
        df = spark.createDataFrame([(k, t, "en", "s", 1, t is None, None) for k, t in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark, source, target, checkpoint).awaitTermination()
        left = {k: t for k, t in (left | dict(rows)).items() if t is not None}
    store = index_at(spark, target)
    same_as_rebuilt(spark, store, left)
    assert sorted(r.chunk for r in store.live("chunks").collect()) == sorted(left.values())


def test_the_session_index_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    others = [(k, "kiwi") for k in (7, 8, 9)]
    spark.createDataFrame([(1, "apple"), *others], "doc_id bigint, text string").write.parquet(path)
    first = retrieval.index_of(spark.read.parquet(path), "t")
    assert retrieval.index_of(spark.read.parquet(path), "t") is first and len(found(spark, first)) == 1
    spark.createDataFrame([(1, "plum"), (2, "fig"), *others], "doc_id bigint, text string").write.mode("overwrite").parquet(path)
    second = retrieval.index_of(spark.read.parquet(path), "t")
    assert second is not first and [r[:2] for r in found(spark, second)] == [(1, 2), (2, 1)]
    made = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("fig").alias("text"))
    assert retrieval.index_of(made, "u") is not retrieval.index_of(made, "u")
