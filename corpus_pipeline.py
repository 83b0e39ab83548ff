"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage calls one operator on all rows that its predecessor kept. Its rows are written as Parquet and read again for
the next stage, so a lost executor repeats one stage at most. All stages but the last return the columns of documents.

Defined results: a null or empty text has no words, which the quality rules reject, so it goes; rows without an id are kept
as others are (of near duplicates, rows with an id stay before them); of repeated rows one stays; an empty table stays empty
through all stages; further columns stay, whatever their names, until the last stage; ties go as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.bpe import token_counts
from strandloom.llm.common import discard, table, written
from strandloom.llm.jaccard import one_of_each
from strandloom.llm.packing import best_fit
from strandloom.llm.pii import mask_personal
from strandloom.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return mask_personal(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences; lengths and places are in tokens of the byte-level vocabulary."""
    import public_tokenizers

    sized = token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return best_fit(sized, size_col="n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Components of near duplicates and packing can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
