"""What went wrong in searches and answers: counts by reason, plan and configuration, the worst examples, advice by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The score under which a search found nothing alike, and advice by what was found.
LOW = 0.3
ADVICE = (
    ("low_similarity", "Consider enabling hybrid search (BM25) for better keyword matching"),
    ("wrong_plan", "Add plan-specific metadata filtering or improve chunking by plan"),
    ("mostly_low", "Consider tuning embeddings or chunking strategy for better semantic understanding"),
)
DIMENSIONS = ("reason", "plan", "config")


def counts(failed: DataFrame) -> DataFrame:
    """(reason, plan, config, level, n, n_low, mean_top) over failures (query_id, reason, plan, config, top_score), by each
    dimension, by reason and configuration, and in all; `level` says which, as a dimension itself may be null."""
    sets = [("reason",), ("plan",), ("config",), ("reason", "config"), ()]
    rows = failed.groupingSets([[F.col(c) for c in s] for s in sets], *DIMENSIONS).agg(
        F.grouping_id(*DIMENSIONS).alias("g"), F.count("*").alias("n"), F.count_if(F.col("top_score") < LOW).alias("n_low"), F.round(F.avg("top_score"), 6).alias("mean_top"))
    level = F.when(F.lit(False), "")
    for s in sets:
        level = level.when(F.col("g") == sum((d not in s) << (len(DIMENSIONS) - 1 - k) for k, d in enumerate(DIMENSIONS)), F.lit("+".join(s) or "all"))
    return rows.select(*DIMENSIONS, level.alias("level"), "n", "n_low", "mean_top")


def examples(failed: DataFrame, by: str, most: int = 5, columns: tuple[str, ...] = ("query_id", "top_score")) -> DataFrame:
    """(`by`, place, columns): the worst failures of each value, lowest score first, ties by query. The limit goes before the
    shuffle, so a value with any share of the failures is no heavy group."""
    w = Window.partitionBy(by).orderBy(F.col("top_score").asc_nulls_first(), "query_id")
    return failed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(by, "place", *columns)


def advice(failed: DataFrame, by: str = "config") -> DataFrame:
    """(`by`, n, advice): for each configuration the advice whose rule holds, in order."""
    has = lambda reason: F.count_if(F.col("reason") == reason) > 0
    holds = {"low_similarity": has("LOW_SIMILARITY"), "wrong_plan": has("WRONG_PLAN"), "mostly_low": F.count_if(F.col("top_score") < LOW) > 0.5 * F.count("*")}
    rows = failed.groupBy(by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in holds.items()])
    return rows.select(by, "n", F.array_compact(F.array(*[F.when(F.col(n), F.lit(t)) for n, t in ADVICE])).alias("advice"))


def generation(answers: DataFrame, overlap: Column, grounded: Column, citations: Column, source_correct: Column, refused: Column) -> DataFrame:
    """(config, n, overlap, grounded, citations, source_accuracy, n_refused): how answers do by configuration."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return answers.groupBy("config").agg(
        F.count("*").alias("n"), mean(overlap).alias("overlap"), mean(grounded).alias("grounded"), mean(citations).alias("citations"), mean(source_correct).alias("source_accuracy"), F.count_if(refused).alias("n_refused"))


def strategies(chunks: DataFrame, strategy: str = "chunker") -> DataFrame:
    """(strategy, n_pages, n_chunks, n_chars, mean_chars): chunks for each way of chunking."""
    return chunks.groupBy(F.col(strategy).alias("strategy")).agg(F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars"))
