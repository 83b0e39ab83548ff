"""What the operators of this subpackage share: reading a table, whole-text Arrow maps, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The separators of `[^\x20\x09-\x0D]+` words, as a Java regular expression and as plain characters.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
SPACES = " \t\n\x0b\f\r"
#: Texts of one Arrow batch; keeps a batch small where single texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def sql_crc32(number: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of a number's decimal digits."""
    bits = f"flatten([[ord(digit)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR digit IN string_split(({number})::VARCHAR, '')])"
    step = "lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295::BIGINT)"


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, rows: Callable[[list[list]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply `rows` to the columns of each Arrow batch, as Python lists; it gives the output rows as tuples."""
    struct = StructType.fromDDL(schema)
    target = arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                out = list(rows([c.to_pylist() for c in part.columns]))
                if out:
                    cols = [pa.array(c, type=f.type) for c, f in zip(zip(*out), target)]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, struct)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under `spark.checkpoint.dir`. Where that is unset, a local session (as in tests) gets a temporary
    folder; on a cluster there is none that all machines share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, tree: str, order: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with idx, the place of each row within its `tree` (from 0) in the given order (nulls first), and n, the rows of
    that tree; without the columns `drop`, which only order it. One range-partitioned sort of all rows: a tree with any share
    of them is spread over many tasks. `tree` is not null; `order` should tell rows apart, else equal ones share a task."""
    ordered = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).drop(*drop)
    placed = written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    in_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_rows").over(in_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(in_tree).alias("n"))
    return placed.join(runs, [tree, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
