import pytest
from pyspark.sql import functions as F
from strandloom.operators import failures, measured

DDL = "query_id int, reason string, plan string, config string, top_score double"
ROWS = [(1, "LOW_SIMILARITY", "p", "a", 0.1), (2, "LOW_SIMILARITY", "q", "a", 0.2), (3, "WRONG_PLAN", "p", "a", 0.4), (4, "WRONG_PLAN", None, "b", 0.45), (5, "UNCERTAIN", "p", "b", None), (1, "LOW_SIMILARITY", "p", "c", 0.29)]


def test_counts(spark):
    out = {(r.level, r.reason, r.plan, r.config): (r.n, r.n_low) for r in failures.counts(spark.createDataFrame(ROWS, DDL)).collect()}
    assert out[("all", None, None, None)] == (6, 3) and out[("plan", None, None, None)] == (1, 0) and out[("plan", None, "p", None)] == (4, 2)
    assert out[("reason+config", "LOW_SIMILARITY", None, "a")] == (2, 2) and out[("config", None, None, "b")] == (2, 0) and len(out) == 1 + 3 + 3 + 3 + 5
    assert [tuple(r)[:5] for r in failures.counts(spark.createDataFrame([], DDL)).collect()] in ([], [(None, None, None, "all", 0)])


def test_worst_examples_are_bounded(spark):
    many = spark.range(20000).select(F.col("id").cast("int").alias("query_id"), F.lit("X").alias("reason"), (F.col("id") / 20000).alias("top_score"))
    rows = failures.examples(many, "reason", 3)
    assert [(r.place, r.query_id) for r in rows.orderBy("place").collect()] == [(1, 0), (2, 1), (3, 2)]
    out = failures.examples(spark.createDataFrame(ROWS, DDL), "config", 2).collect()
    assert {(r.config, r.place, r.query_id) for r in out} == {("a", 1, 1), ("a", 2, 2), ("b", 1, 5), ("b", 2, 4), ("c", 1, 1)}


def test_advice(spark):
    out = {r.config: list(r.advice) for r in failures.advice(spark.createDataFrame(ROWS, DDL)).collect()}
    text = dict(failures.ADVICE)
    assert out == {"a": [text["low_similarity"], text["wrong_plan"], text["mostly_low"]], "b": [text["wrong_plan"]], "c": [text["low_similarity"], text["mostly_low"]]}


def test_generation(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0, 2, True, False), ("a", None, 0.0, 0, False, True), ("b", 1.0, 1.0, 1, None, False)], "config string, o double, g double, c int, s boolean, r boolean")
    out = {r.config: tuple(r)[1:] for r in failures.generation(df, *[F.col(c) for c in "ogcsr"]).collect()}
    assert out == {"a": (2, 0.5, 0.5, 1.0, 0.5, 1), "b": (1, 1.0, 1.0, 1.0, None, 0)}


def test_runs_are_measured(spark, tmp_path):
    path, out = str(tmp_path / "runs"), str(tmp_path / "out")
    put = lambda df: df.write.mode("overwrite").parquet(out)
    even = {"even": F.count_if(F.col("id") % 2 == 0), "total": F.sum("id")}
    assert measured.measured(spark.range(101), "a", path, put, even) == {"rows": 101, "even": 51, "total": 5050}
    assert measured.measured(spark.range(0), "a", path, put, even) == {"rows": 0, "even": 0, "total": 0}
    with pytest.raises(ZeroDivisionError):
        measured.measured(spark.range(1), "b", path, lambda df: 1 / 0)
    rows = measured.runs(spark, path)
    assert sorted((r.config, r.ok, r.counts.get("rows")) for r in rows.collect()) == [("a", True, 0), ("a", True, 101), ("b", False, None)]
    report = {r.config: (r.n, r.n_failed, r.slowest is not None) for r in measured.latencies(rows, F.col("config"), F.col("seconds"), F.col("ok")).collect()}
    assert report == {"a": (2, 0, True), "b": (1, 1, False)} and all(r.seconds >= 0 for r in rows.collect())


def test_percentiles(spark):
    df = spark.createDataFrame([("x", float(k)) for k in range(1, 101)] + [("y", None)], "c string, s double")
    out = {r.config: (r.n, r.mean, r.p50, r.p95, r.slowest) for r in measured.latencies(df, F.col("c"), F.col("s")).collect()}
    assert out == {"x": (100, 50.5, 50.5, 95.05, 100.0), "y": (1, None, None, None, None)}
