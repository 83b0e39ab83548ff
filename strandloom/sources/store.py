"""Where derived tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below `spark.checkpoint.dir`; where that is unset, a local session gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "rows") -> DataFrame:
    """Rows in a new folder, read from there."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_unions(spark: SparkSession) -> None:
    """Let a union count as partitioned in no way. Spark 4.1 takes a union of inputs with one partitioning as so partitioned
    even where adaptive execution has put their partitions together differently, and then groups rows of one key apart."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def commit(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Put a small text into a new file that appears whole; an error if there is one of that name already."""
    fs, to = file_system(spark, f"{folder}/{name}")
    _, draft = file_system(spark, f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to) or not fs.rename(draft, to):
        fs.delete(draft, False)
        raise FileExistsError(f"{folder}/{name} was committed by another writer")
