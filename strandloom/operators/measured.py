"""Figures of runs, measured while they run: rows that pass are counted by observations of the plan itself, seconds are
taken around it, and each run is a row of a table, from which configurations are compared."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "config string, run string, seconds double, ok boolean, error string, counts map<string,bigint>"


def measured(df: DataFrame, config: str, path: str, write: Callable[[DataFrame], None], counts: dict[str, Column] | None = None) -> dict[str, int]:
    """Write `df`, count what passes (rows, and any aggregates in `counts`) in the same pass, and append one row on the run to
    the table at `path`; a run that fails is a row too, and raises. An observed count of an empty table is 0."""
    seen = Observation(uuid.uuid4().hex)
    every = {"rows": F.count(F.lit(1)), **(counts or {})}
    began, found, error = time.perf_counter(), {}, None
    try:
        write(df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in every.items()]))
        found = {n: int(v or 0) for n, v in seen.get.items()}
    except Exception as failure:
        error = str(failure)[:500]
        raise
    finally:
        row = (config, uuid.uuid4().hex, time.perf_counter() - began, error is None, error, found)
        df.sparkSession.createDataFrame([row], RUNS).write.mode("append").parquet(path)
    return found


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def latencies(rows: DataFrame, config: Column, seconds: Column, ok: Column | None = None) -> DataFrame:
    """(config, n, n_failed, mean, p50, p95, slowest) of measured seconds; failed runs count as such only."""
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    rows = rows.select(config.alias("config"), F.when(good, seconds.cast("double")).alias("s"), good.alias("ok"))
    figures = {"mean": F.avg("s"), "p50": F.percentile("s", F.lit(0.5)), "p95": F.percentile("s", F.lit(0.95)), "slowest": F.max("s")}
    return rows.groupBy("config").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed"), *[F.round(c, 6).alias(n) for n, c in figures.items()])
