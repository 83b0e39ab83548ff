"""Long sequences in blocks: places, neighbours and running counts of rows in an order, however many rows a sequence has.

All rows are sorted once by range, so a sequence is spread over as many tasks as it has rows for; windows are over blocks of
`BLOCK` rows, and what goes from block to block (the next one's first row, the count so far) is one row for each block.

Defined results: a null key is a sequence of its own; rows with equal order are taken as they come, but a written table
holds that order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.sources.store import new_folder

BLOCK = 4096


def written(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "sequence")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """`df` with `_key` (the key as text), `_idx`, the place of each row in its sequence from 0, and `_block`."""
    rows = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    rows = rows.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = rows.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_key", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = rows.join(runs, ["_key", "_part"]).withColumn("_idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
    return rows.withColumn("_block", F.expr(f"_idx div {block}"))


def with_next(rows: DataFrame, column: str, name: str, block: int = BLOCK) -> DataFrame:
    """Placed rows with the value that the next row of their sequence has; null for the last."""
    heads = rows.where(F.col("_idx") % block == 0).select("_key", (F.col("_block") - 1).alias("_block"), F.col(column).alias("_head"))
    inner = F.lead(column).over(Window.partitionBy("_key", "_block").orderBy("_idx"))
    rows = rows.withColumn(name, inner).join(heads, ["_key", "_block"], "left")
    return rows.withColumn(name, F.coalesce(name, F.when(F.col("_idx") % block == block - 1, F.col("_head")))).drop("_head")


def counted_before(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Placed rows with the number of rows before them in their sequence that meet a condition."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    sums = rows.groupBy("_key", "_block").agg(F.sum("_flag").alias("_sum"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_block", F.coalesce(F.sum("_sum").over(earlier("_key").orderBy("_block")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_flag").over(earlier("_key", "_block").orderBy("_idx")), F.lit(0))
    return rows.withColumn(name, within).join(sums, ["_key", "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_flag", "_before")


def breakpoints(df: DataFrame, key: str, order: str, vector: str, least: float = 0.5, block: int = BLOCK) -> DataFrame:
    """`df` with `cosine` (with the next vector of the sequence, rounded to 6 places) and `segment`: a new one begins after each
    pair of neighbours that are less alike."""
    columns = df.columns
    rows = with_next(placed(df, key, [order], block), vector, "_next", block)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(vector, vector)) * F.sqrt(dot("_next", "_next"))
    rows = rows.withColumn("cosine", F.round(F.when(norm == 0, F.lit(0.0)).otherwise(dot(vector, "_next") / norm), 6))
    return counted_before(rows, F.col("cosine") < least, "segment").select(*columns, "cosine", "segment")
