"""Operator 2: language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs of the training rows are gathered once: each task counts its n-grams in chunks and sends
them, as sorted arrays, to the segment of their hash; a segment adds them up. A count c is quantised to level
1 + floor(log c / log BASE), and the filter holds (n-gram, level) for every level up to that, so that probing level after
level until one is absent gives the quantised count back. A pair's probability is smoothed with the word's (Dirichlet
prior of weight `MU`), all from probed counts.

The filter grows with the corpus, in segments sized on the number of words of all training texts. It is broadcast only
while its measured size is at most `MOST_FILTER_BYTES`; beyond, it stays in its segments: blocks of texts send their
distinct n-grams, each once for a block however frequent it is, to the segments, where they are counted and then probed in
the segment's bits by the same code, and the levels go back to the blocks. So scores are the same at every size. A block
sends at most 2 ** GROUPS_POWER rows: where there are more segments than that, its rows go to groups of segments, in which
batches of many blocks are cut into segments, so that few rows go to each, and the levels go back over the batches.
Exact counts for the base score: at most `MOST_HEAVY` frequent words are broadcast (the threshold rises until that
holds), and the rarer words of each text are joined, in which no key is frequent.

A pair's probability is that of counts which are quantised and may be found too high, so that a context's
probabilities sum to about 1, not exactly; it is a score.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, then one end.

Defined results: a null or empty text is the end alone; every row gives a row, repeated rows too; a row without an id is
in training (its id is an empty text); whole texts are read; with no training rows all counts are 0; columns other than
the id and the text are ignored. n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BATCH_ROWS, arrow_schema, table, written
from .jaccard import Tokens, mixed

#: Ratio of neighbouring count levels; filter bits for each level held; probes of a membership test.
BASE, BITS, PROBES = 1.5, 8, 5
#: Largest filter that is broadcast, and most frequent words whose exact counts are.
MOST_FILTER_BYTES, MOST_HEAVY = 128 << 20, 500_000
#: Weight of the word's own probability in that of a pair.
MU = 3000.0
#: Tokens of a chunk that a task counts at once, and n-grams of a segment, about.
CHUNK, SEGMENT = 3_000_000, 3_000_000
#: Text bytes of a block, about; n-grams for each byte of the bound from which on blocks are made without measuring first.
BLOCK_BYTES, CLEARLY = 8 << 20, 8
#: Groups of segments, as a power of two at most, and blocks of a batch, about.
GROUPS_POWER, BATCH_BLOCKS = 12, 1024
#: Words of a text.
WORD = "[^\\x20\\x09-\\x0D]+"

END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_MUL, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def tokens_of(texts: list[str | None], memo: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each, and the number of tokens of each text. Word hashes are even."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = np.array([len(w) + 1 for w in words])
    out = np.empty(n.sum(), np.uint64)
    ends = np.cumsum(n) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = np.fromiter((memo[x] for w in words for x in w), np.uint64, keep.sum())
    out[ends] = END
    return out & ~_ONE, n


def pairs_of(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (a start for the first of a text), and the hash of both. Pair hashes are odd."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(n) - n] = START
    return before, mixed(before * _MUL + tokens) | _ONE


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    low = np.ceil(BASE ** np.maximum(level - 1, 0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(level, 1) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def segment_of(grams: np.ndarray, power: int) -> np.ndarray:
    return (grams >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(grams), np.int64)


def places(grams: np.ndarray, level: int, bits: np.ndarray):
    """Bit places of (n-gram, level) in a segment of so many bits, one array for each probe."""
    a = mixed(grams * _MUL + np.uint64(level))
    b = mixed(a) | _ONE
    for k in range(PROBES):
        yield ((a + b * np.uint64(k)) % bits.astype(np.uint64)).astype(np.int64)


def filter_of(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The packed bits of a segment."""
    size = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in places(grams[level >= j], j, np.array([size])):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """The segments' bits in one array."""

    def __init__(self, segments: dict[int, bytes], power: int):
        self.power = power
        sizes = np.array([len(segments.get(k, b"")) for k in range(1 << power)], np.int64)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes * 8
        self.bits = np.frombuffer(b"".join(segments.get(k, b"") for k in range(1 << power)), np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: each n-gram goes on to the next level while it is found."""
        level = np.zeros(len(grams), np.int64)
        segment = segment_of(grams, self.power)
        open_ = np.flatnonzero(self.size[segment] > 0)
        j = 1
        while len(open_):
            alive = open_
            a = mixed(grams[alive] * _MUL + np.uint64(j))
            b = mixed(a) | _ONE
            size, start = self.size[segment[alive]].astype(np.uint64), self.start[segment[alive]]
            for k in range(PROBES):
                at = ((a + b * np.uint64(k)) % size).astype(np.int64)
                hit = ((self.bits[start + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                alive, a, b, size, start = alive[hit], a[hit], b[hit], size[hit], start[hit]
            level[alive] = j
            open_ = alive
            j += 1
        return level


class Table:
    """Levels of n-grams that were brought to their texts: sorted hashes and their levels."""

    def __init__(self, grams: np.ndarray, level: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.level = grams[order], level[order]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.level[at], 0)


def log_probabilities(tokens: np.ndarray, n: np.ndarray, model, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each token after the one before it."""
    before, pairs = pairs_of(tokens, n)
    words, word_at = np.unique(tokens, return_inverse=True)
    both, pair_at = np.unique(pairs, return_inverse=True)
    counts = count_of(model.levels(words))
    word = counts[word_at]
    context = np.empty(len(tokens))
    context[1:] = word[:-1]
    ends = count_of(model.levels(np.array([END & ~_ONE])))[0]
    context[np.cumsum(n) - n] = ends  # as many starts as ends
    pair = np.minimum(count_of(model.levels(both))[pair_at], np.minimum(context, word))
    alone = (word + 1) / (total + distinct + 1)
    return np.log10((pair + MU * alone) / (context + MU))


def counted(docs: DataFrame, power: int) -> DataFrame:
    """One row for each segment: its filter, and its words with exact counts."""
    sent = StructType.fromDDL("segment bigint, grams binary, counts binary")
    target = arrow_schema(sent)

    def send(batches):
        np.seterr(over="ignore")
        memo, held, size = Tokens(), [], 0

        def flush():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(segment_of(grams, power), np.arange((1 << power) + 1))
            full = np.flatnonzero(np.diff(cuts))
            for part in np.array_split(full, max(1, len(full) // 64)):
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.int64()), pa.array([grams[cuts[s] : cuts[s + 1]].tobytes() for s in part], pa.binary()),
                    pa.array([counts[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes() for s in part], pa.binary())], schema=target)

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                tokens, n = tokens_of(batch.column(0).slice(start, BATCH_ROWS).to_pylist(), memo)
                held += [tokens, pairs_of(tokens, n)[1]]
                size += len(tokens)
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")
        every = np.frombuffer(b"".join(part["grams"]), np.uint64)
        order = np.argsort(every, kind="stable")
        grams, counts = every[order], np.frombuffer(b"".join(part["counts"]), np.uint32)[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        grams, counts = grams[first], np.add.reduceat(counts, first)
        level = levels(counts)
        word = (grams & _ONE) == 0
        return pd.DataFrame({
            "segment": [part["segment"].iloc[0]], "bits": [filter_of(grams, level).tobytes()], "words": [grams[word].tobytes()], "word_counts": [counts[word].tobytes()],
            "tokens": [int(counts[word].sum())], "distinct": [int(word.sum())]})

    rows = docs.select("text").mapInArrow(send, sent)
    return rows.groupBy("segment").applyInPandas(add_up, "segment bigint, bits binary, words binary, word_counts binary, tokens bigint, distinct bigint")


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, rows): the rows of `docs` packed in blocks; a block has the row number of its first row."""
    struct = StructType.fromDDL("block bigint, rows binary")
    target = arrow_schema(struct)

    def pack(batches):
        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([held[0].column(2).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=target)

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS // 10):
                held.append(batch.slice(start, BATCH_ROWS // 10))
                size += held[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "held_out", "row", "text").mapInArrow(pack, struct)


def rows_of(block: bytes):
    """The rows of a block in batches."""
    for batch in pa.ipc.open_stream(block).read_all().combine_chunks().to_batches():
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def sent_blocks(blocks: DataFrame, groups: int) -> DataFrame:
    """(block, grp, grams, counts): the distinct n-grams of each block in order, with their counts in its training rows, cut
    by group; `groups` is a power of two's exponent."""
    sent = StructType.fromDDL("block bigint, grp bigint, grams binary, counts binary")
    target = arrow_schema(sent)

    def send(batches):
        np.seterr(over="ignore")
        memo = Tokens()
        for batch in batches:
            for block, rows in zip(batch.column(0), batch.column(1)):
                train, rest = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for part in rows_of(rows.as_py()):
                    tokens, n = tokens_of(part.column(3).to_pylist(), memo)
                    pairs, away = pairs_of(tokens, n)[1], np.repeat(np.array(part.column(1).to_pylist(), bool), n)
                    train += [tokens[~away], pairs[~away]]
                    rest += [tokens[away], pairs[away]]
                known, c = np.unique(np.concatenate(train), return_counts=True)
                grams = np.union1d(known, np.concatenate(rest))
                counts = np.zeros(len(grams), np.uint32)
                counts[np.searchsorted(grams, known)] = c
                cuts = np.searchsorted(segment_of(grams, groups), np.arange((1 << groups) + 1))
                full = np.flatnonzero(np.diff(cuts))
                for part in np.array_split(full, max(1, len(full) // 64)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.as_py()] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([grams[cuts[s] : cuts[s + 1]].tobytes() for s in part], pa.binary()),
                        pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in part], pa.binary())], schema=target)

    return blocks.mapInArrow(send, sent)


BATCHES = "grp bigint, slot bigint, segment bigint, grams binary, counts binary, block bigint, places binary"


def batched(sent: DataFrame, power: int, slots: int) -> DataFrame:
    """Rows of blocks put together in batches of a group: for each segment the batch's distinct n-grams in order and their
    counts (with block null), and for each block the places of its n-grams among the batch's (with segment null)."""
    target = arrow_schema(StructType.fromDDL(BATCHES))

    def of(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        grams, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(at, np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32), len(grams)).astype(np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        segment = segment_of(grams, power)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        cuts = [*first.tolist(), len(grams)]
        n, m = len(first), len(parts)
        key = [rows.column(c)[0].as_py() for c in ("grp", "slot")]
        columns = [
            [key[0]] * (n + m), [key[1]] * (n + m), [*segment[first].tolist(), *[None] * m], [*(grams[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), *[None] * m], [*(counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), *[None] * m],
            [*[None] * n, *rows.column("block").to_pylist()], [*[None] * n, *(at[e - len(p) : e].astype(np.uint32).tobytes() for e, p in zip(ends, parts))],
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return sent.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).groupBy("grp", "slot").applyInArrow(of, BATCHES)


SUMMED = "grp bigint, slot bigint, segment bigint, levels binary, words binary, word_counts binary, tokens bigint, distinct bigint"


def counted_blocks(blocks: DataFrame, power: int) -> tuple[DataFrame, DataFrame]:
    """What `counted` gives of each segment but its bits, and the levels of every block's n-grams (block, grp, levels) in the
    order of the hashes."""
    sent = sent_blocks(blocks, min(power, GROUPS_POWER))
    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")
        every = np.frombuffer(b"".join(part["grams"]), np.uint64)
        grams, at = np.unique(every, return_inverse=True)
        counts = np.bincount(at, np.frombuffer(b"".join(part["counts"]), np.uint32), len(grams)).astype(np.int64)
        known = counts > 0
        bits = filter_of(grams[known], levels(counts[known]))
        found = Filter({0: bits.tobytes()}, 0).levels(grams).astype(np.uint8)[at]
        word = known & ((grams & _ONE) == 0)
        cuts = np.cumsum([0, *(len(g) // 8 for g in part["grams"])])
        head = {"grp": [None], "slot": [None], "segment": [part["segment"].iloc[0]], "levels": [b""], "words": [grams[word].tobytes()], "word_counts": [counts[word].tobytes()], "tokens": [int(counts[word].sum())], "distinct": [int(word.sum())]}
        back = {"grp": part["grp"], "slot": part["slot"], "segment": part["segment"], "levels": [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}
        out = {k: [*v, *back.get(k, [None] * len(part))] for k, v in head.items()}
        return pd.DataFrame({k: pd.array(v, "Int64") if k in ("grp", "slot", "segment", "tokens", "distinct") else v for k, v in out.items()})

    if power <= GROUPS_POWER:  # a group is a segment
        messages = sent.select("grp", F.col("block").alias("slot"), F.col("grp").alias("segment"), "grams", "counts")
        both = written(messages.groupBy("segment").applyInPandas(add_up, SUMMED))
        return both.where("grp IS NULL"), both.where("grp IS NOT NULL").select(F.col("slot").alias("block"), "grp", "levels")

    slots = max(1, math.ceil(blocks.count() / BATCH_BLOCKS))
    batches = written(batched(sent, power, slots))
    messages = batches.where("segment IS NOT NULL").select("grp", "slot", "segment", "grams", "counts")
    both = written(messages.groupBy("segment").applyInPandas(add_up, SUMMED))

    def deliver(members: pa.Table, replied: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(replied.sort_by("segment").column("levels").to_pylist()), np.uint8)
        back = [found[np.frombuffer(p, np.uint32)].tobytes() for p in members.column("places").to_pylist()]
        return pa.Table.from_arrays([members.column("block"), members.column("grp"), pa.array(back, pa.binary())], names=["block", "grp", "levels"])

    members = batches.where("block IS NOT NULL").select("grp", "slot", "block", "places")
    replies = both.where("grp IS NOT NULL").select("grp", "slot", "segment", "levels")
    return both.where("grp IS NULL"), members.groupBy("grp", "slot").cogroup(replies.groupBy("grp", "slot")).applyInArrow(deliver, "block bigint, grp bigint, levels binary")


def unpacked(rows: DataFrame, hashes: str, values: str, kind, name: str, keep=None) -> DataFrame:
    """Packed arrays of hashes and values as rows (h, name); keep picks by value."""
    schema = StructType.fromDDL(f"h bigint, {name} bigint")
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                h, v = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), kind).astype(np.int64)
                if keep is not None:
                    h, v = h[keep(v)], v[keep(v)]
                for at in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(v[at : at + 100_000])], schema=target)

    return rows.select(hashes, values).mapInArrow(run, schema)


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most_filter_bytes: int | None = None, most_heavy: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    most_filter_bytes = MOST_FILTER_BYTES if most_filter_bytes is None else most_filter_bytes
    most_heavy = MOST_HEAVY if most_heavy is None else most_heavy
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    train = docs.where(~F.col("held_out"))
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint") + 1
    grams = 2 * (docs.agg(F.sum(tokens)).first()[0] or 0)
    power = min(30, max(0, math.ceil(math.log2(max(1.0, grams / SEGMENT)))))

    blocks = None
    if grams <= CLEARLY * most_filter_bytes:
        segments = written(counted(train, power))
        filter_bytes = segments.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    if grams > CLEARLY * most_filter_bytes or filter_bytes > most_filter_bytes:
        blocks = written(blocks_of(docs))
        segments, replies = counted_blocks(blocks, power)
    sizes = segments.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, distinct = sizes["n"], sizes["v"]

    # The least power of two from which on at most `most_heavy` words are as frequent.
    word_counts = unpacked(segments, "words", "word_counts", np.int64, "c")
    steps = word_counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().collect()
    least = 1
    while sum(r["count"] for r in steps if 2 ** r["power"] >= least) > most_heavy:
        least *= 2
    bound = least
    heavy_rows = unpacked(segments, "words", "word_counts", np.int64, "c", lambda v: v >= bound).toPandas()
    heavy_rows = heavy_rows.assign(h=heavy_rows["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    heavy = spark.sparkContext.broadcast((heavy_rows["h"].to_numpy(), heavy_rows["c"].to_numpy()))
    all_heavy = len(heavy_rows) == distinct

    schema = StructType.fromDDL("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_heavy bigint, logs double, score double, rare array<struct<h:bigint,tf:bigint>>")
    target = arrow_schema(schema)

    def scores_of(part, counted_tokens, logs_of):
        heavy_h, heavy_c = heavy.value
        tokens, n = counted_tokens
        firsts = np.cumsum(n) - n
        logs = logs_of(part, tokens, n)
        if len(heavy_h):
            at = np.minimum(np.searchsorted(heavy_h, tokens), len(heavy_h) - 1)
            hit = heavy_h[at] == tokens
            c = np.where(hit, heavy_c[at], 0)
        else:
            hit, c = np.zeros(len(tokens), bool), np.zeros(len(tokens))
        rare = []
        for a, k in zip(firsts, n):
            own = [] if all_heavy else tokens[a : a + k][~hit[a : a + k]].view(np.int64)
            rare.append([{"h": int(h), "tf": int(f)} for h, f in zip(*np.unique(own, return_counts=True))] if len(own) else [])
        add = lambda x: np.add.reduceat(x, firsts)
        return pa.RecordBatch.from_arrays([
            part.column(2), part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(add(hit.astype(np.int64))), pa.array(add(np.log10(c + 1.0))), pa.array(add(logs)), pa.array(rare, target.field("rare").type)], schema=target)

    def mapped(source: DataFrame, logs_of) -> DataFrame:
        def run(batches):
            np.seterr(over="ignore")
            memo = Tokens()
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    yield scores_of(part, tokens_of(part.column(3).to_pylist(), memo), logs_of)

        return source.mapInArrow(run, schema)

    if blocks is not None:

        def of_block(block: pa.Table, replied: pa.Table) -> pa.Table:
            np.seterr(over="ignore")
            memo, parts = Tokens(), [p for rows in block.column("rows") for p in rows_of(rows.as_py())]
            read = [tokens_of(p.column(3).to_pylist(), memo) for p in parts]
            grams = np.unique(np.concatenate([x for tokens, n in read for x in (tokens, pairs_of(tokens, n)[1])]))
            replied = replied.sort_by("grp")
            model = Table(grams, np.frombuffer(b"".join(replied.column("levels").to_pylist()), np.uint8).astype(np.int64))
            return pa.Table.from_batches([scores_of(p, c, lambda _, tokens, n: log_probabilities(tokens, n, model, total, distinct)) for p, c in zip(parts, read)], target)

        scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(of_block, schema)
    else:
        model = spark.sparkContext.broadcast(Filter({r["segment"]: bytes(r["bits"]) for r in segments.select("segment", "bits").toLocalIterator()}, power))
        scored = mapped(docs.select("doc_id", "held_out", "row", "text"), lambda _, tokens, n: log_probabilities(tokens, n, model.value, total, distinct))
    floor = math.log10(total + distinct + 1)
    if not all_heavy:
        scored = written(scored)
        rare_counts = unpacked(segments, "words", "word_counts", np.int64, "c", lambda v: v < bound)
        met = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.h").alias("h"), F.col("r.tf").alias("tf")).join(rare_counts, "h")
        sums = met.groupBy("row").agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"))
        scored = scored.drop("rare").join(sums, "row", "left")
    else:
        scored = scored.withColumns({"n_rare": F.lit(0).cast("bigint"), "more": F.lit(0.0)})
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_heavy") + F.coalesce("n_rare", F.lit(0))).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return lm_scores(table(spark, sf_dir, "documents"), held_out)
