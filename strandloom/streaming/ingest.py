"""Incremental ingestion: new document files become chunks and postings of an index that is kept up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import structure
from strandloom.operators.search_index import IndexStore

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, deleted boolean, version bigint"


def index_at(spark: SparkSession, target: str) -> IndexStore:
    """The index and chunks that `ingest_stream` keeps at `target`."""
    return IndexStore(spark, target, structure.greedy_chunks)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = SCHEMA) -> StreamingQuery:
    """Read new Parquet files of documents and keep the index at `target` up to date: a document that comes again replaces
    the one of its id, one that is marked as deleted goes. Ends when all files at hand are taken. A batch that is run again
    after a failure changes nothing."""
    store = index_at(spark, target)

    def take(batch: DataFrame, number: int) -> None:
        store.apply(batch, checkpoint, number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
