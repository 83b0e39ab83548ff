"""Operator 8: variable-capacity best-fit packing of documents into training sequences.

A document of at most the largest permitted length is one piece; a longer one is cut into pieces of that length and a
rest, none of it lost. Pieces are packed longest first. Each goes to the open bin with the least room that holds it; if
there is none, a bin is opened of the permitted length with the least cost per token, given what is still to be packed
and so can fill it. In the end each bin is downsized to the least permitted length that holds its contents. All permitted
lengths compete in one pass, so a short rest opens a short bin where that is cheaper, and a long one where others fill it.

Pieces are dealt out by row number into shards of bounded size, so no key and no document can make one large; a shard is
packed by itself, and only lengths and identifiers are moved, never texts. What is packed is written to the shared
folder first, so that a lost executor repeats the same shards.

Lengths are in words, or in the tokens of any tokenizer if a column has their number for each row (that of operator 6, say);
pieces are then ranges of tokens. `sequences` gathers the pieces of each sequence in order, to assemble it from.

Defined results: a null, empty or blank text has no piece; repeated rows are packed as often as they occur; ties in
length go by identifier, piece and row number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of, written

#: Permitted sequence lengths.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces of a shard, about.
SHARD_PIECES = 50_000


def cost(length: int, overhead: float = 64.0, attention: float = 16384.0) -> float:
    """Cost of a sequence: a fixed part, one that is linear and one that is quadratic in its permitted length."""
    return overhead + length + length * length / attention


def pack(sizes: list[int], lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, permitted length, offset) of each piece; sizes are in descending order and at most max(lengths)."""
    lengths = tuple(sorted(lengths))
    rest = sum(sizes)
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r is set where a bin with room r is open
    used: list[int] = []
    placed: list[tuple[int, int]] = []
    for size in sizes:
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, rest), c))
            k = len(used)
            used.append(0)
        placed.append((k, used[k]))
        used[k] += size
        rest -= size
        if room > size:
            rooms.setdefault(room - size, []).append(k)
            mask |= 1 << (room - size)
    final = [next(c for c in lengths if c >= n) for n in used]
    return [(k, final[k], offset) for k, offset in placed]


def pieces_of(docs: DataFrame, lengths: tuple[int, ...], id_col: str, text_col: str, size_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start and size, and a row number."""
    top = max(lengths)
    size = F.size(words_of(F.col(text_col))) if size_col is None else F.col(size_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), size.cast("bigint").alias("n"), F.monotonically_increasing_id().alias("row")).where("n > 0")
    cut = sized.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {top}"))).alias("piece"))
    return cut.select("doc_id", "row", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("bigint").alias("size"))


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """Per piece its sequence, the permitted length of that, and the place of the piece in it."""
    pieces = written(pieces_of(docs, lengths, id_col, text_col, size_col))
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("bigint"))

    def of(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        out = pack(shard["size"].tolist(), lengths)
        shard = shard[["doc_id", "piece", "start", "size", "shard"]].copy()
        shard["bin"], shard["bin_length"], shard["offset"] = ([x[k] for x in out] for k in range(3))
        return shard[["doc_id", "piece", "start", "size", "shard", "bin", "bin_length", "offset"]]

    packed = dealt.groupBy("shard").applyInPandas(of, "doc_id bigint, piece bigint, start bigint, size bigint, shard bigint, bin bigint, bin_length bigint, offset bigint")
    return packed.select("doc_id", "piece", "start", "size", F.concat_ws("-", "shard", "bin").alias("sequence_id"), "bin_length", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its permitted length, how much of it is used, and its pieces (document, start, size) in
    order; at most as many pieces as the longest permitted length."""
    piece = F.struct("offset", "doc_id", "start", "size")
    rows = packed.groupBy("sequence_id", "bin_length").agg(F.sum("size").alias("used"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return rows.select("sequence_id", "bin_length", "used", "pieces")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
