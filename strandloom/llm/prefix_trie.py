"""Operator 11: the trie of conversation prefixes, counted in node tables with minimal perfect hashes.

A prefix is known by the XOR of 120-bit digests of its turns, each taken with its depth, so that prefixes of a conversation
are one running aggregate. Distinct prefixes are enumerated by an aggregation that combines before its shuffle, and dealt to
shards by the top of the largest subtree that holds at most `SHARD` rows. A shard builds a minimal perfect hash of its
digests, verifies each slot by the digest that it holds, scatters the nodes' figures into flat arrays by slot, resolves the
slot of each node's parent in the same way, and adds children to parents in order of depth, deepest first.

What is above those subtrees (the root, first turns that a large share of all conversations have) is the input of the next
round: prefixes on the paths of their smallest members only, with the totals that the shards sent up, summed by parent before
the shuffle. At any depth there are at most rows / SHARD of them, so a round leaves that many for each depth; a
conversation of more than SHARD turns that stands alone takes a round for each SHARD of them.

`members` of a node that end there are hashed as a stream in order of their ids: ids are joined into texts of up to 1,024
ids first, so a group of copies of any size is a short run of rows in one task, never a collected group.

Defined results: turns of equal number are ordered by role, then text, and repeated rows are turns of their own; a null
conversation id takes no part (its rows belong to no conversation); null roles and texts are empty; `%` has the sign of the
id; an empty table gives no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, ranked, sql_crc32, table, written
from .jaccard import mixed

#: Rows of a shard, about, and the largest subtree that is not cut.
SHARD = 4096
#: Turns of a conversation that one window takes; longer ones are scanned in blocks of so many.
WINDOW_TURNS = 1 << 16
#: Conversations share their head with the one whose id is the next lower multiple of `GROUP`; a head has under `HEAD` turns.
GROUP, HEAD = 5, 9
#: Ids that are joined before they are hashed, as a power of two.
IDS_POWER = 10

_MUL, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class SlotTable:
    """A minimal perfect hash of distinct 120-bit digests: a level's bit is set where exactly one of the keys left falls; that
    key's slot is the number of bits set before. Each slot holds its digest, so that other keys are told apart."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.starts, self.sizes, bits = [], [], []
        left = np.arange(len(a))
        at = level = 0
        while len(left):
            size = 2 * len(left)
            place = self.place(a[left], b[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            self.starts.append(at)
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[place]]
            at += size
            level += 1
            if level > 200:
                raise ValueError("digests are not distinct")
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits) - self.bits
        self.a, self.b = np.zeros((2, len(a)), np.int64)
        slots = self.lookup(a, b, verify=False)
        self.a[slots], self.b[slots] = a, b
        if len(np.unique(slots)) != len(a) or (self.slots(a, b) < 0).any():
            raise ValueError("digests are not distinct")

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(a.view(np.uint64) * _MUL + b.view(np.uint64) * _ODD + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray, verify: bool) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes)):
            place = start + self.place(a[left], b[left], level, size)
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
        if verify:
            known = out >= 0
            known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
            out[~known] = -1
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table does not hold it."""
        return self.lookup(np.ascontiguousarray(a), np.ascontiguousarray(b), verify=True)


COUNTS = ("a", "b", "pa", "pb", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODE = pa.schema([*((c, pa.int64()) for c in COUNTS), ("is_top", pa.bool_())])
NODE_DDL = ", ".join(f"{c} bigint" for c in COUNTS) + ", is_top boolean"


def accumulated(shard: pa.Table) -> pa.Table:
    """The finished nodes of a shard, which holds whole subtrees."""
    col = {c: shard.column(c).to_numpy() for c in ("a", "b", "pa", "pb", "depth", "conv_id", "cnt", "bytes", "kids", "leaves", "saved", "cut")}
    top_conv = shard.column("top_conv").to_pylist()
    nodes = SlotTable(col["a"], col["b"])
    slot = nodes.slots(col["a"], col["b"])
    n = len(slot)

    def scattered(values):
        flat = np.zeros(n, np.int64)
        np.add.at(flat, slot, values)
        return flat

    depth, count, n_bytes, conv, children, leaves, saved, cut = map(scattered, (col[c] for c in ("depth", "cnt", "bytes", "conv_id", "kids", "leaves", "saved", "cut")))
    saved += (count - 1) * n_bytes
    top = depth == cut
    parent = np.full(n, -1, np.int64)
    parent[slot] = nodes.slots(col["pa"], col["pb"])
    parent[top] = -1
    if (parent[~top] < 0).any():
        raise ValueError("a node's parent is not in its shard")
    by_depth = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[by_depth], append=-1))
    start = 0
    for end in ends:
        layer = by_depth[start : end + 1]
        leaves[layer] += children[layer] == 0
        inner = layer[parent[layer] >= 0]
        np.add.at(children, parent[inner], 1)
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
        start = end + 1
    above = np.empty(n, object)
    above[slot] = np.array(top_conv, object)
    inner = parent >= 0
    above[inner] = conv[parent[inner]]
    out = {"a": nodes.a, "b": nodes.b, "pa": scattered(col["pa"]), "pb": scattered(col["pb"]), "depth": depth, "conv_id": conv, "parent_conv_id": above, "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "is_top": top}
    return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in NODE], schema=NODE)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place of the turn in its conversation (from 1), digest of role and text, bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    named = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    return ranked(named, "conv_id", ["turn", "role", "text", "row"], ("turn", "role", "text", "row")).select("conv_id", (F.col("idx") + 1).alias("p"), F.col("digest").alias("turn"), "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, turn, bytes) of the rebuilt conversations. Only the heads of base conversations are repeated,
    each for the few ids that share it."""
    own = turns.join(convs, "conv_id").where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.least("h", "m")).alias("depth"), "turn", "bytes")
    heads = turns.where(F.col("p") < HEAD).withColumnRenamed("conv_id", "base")
    return own.unionByName(convs.select("conv_id", "base", "h").join(heads, "base").where("p <= h").select("conv_id", F.col("p").alias("depth"), "turn", "bytes"))


def running_xor(rows: DataFrame, most: int) -> DataFrame:
    """`rows` (conv_id, depth, x, y) with a, b: the XOR of x and of y over all depths up to the row's."""
    if most <= WINDOW_TURNS:
        path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({"a": F.bit_xor("x").over(path), "b": F.bit_xor("y").over(path)})
    rows = rows.withColumn("block", F.expr(f"depth div {WINDOW_TURNS}"))
    sums = rows.groupBy("conv_id", F.col("block").alias("depth")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = running_xor(sums, most // WINDOW_TURNS).select("conv_id", F.col("depth").alias("block"), F.expr("a ^ x").alias("a0"), F.expr("b ^ y").alias("b0"))
    path = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("x").over(path), "b": F.bit_xor("y").over(path)}).join(before, ["conv_id", "block"])
    return rows.withColumns({"a": F.expr("a ^ a0"), "b": F.expr("b ^ b0")}).drop("block", "a0", "b0")


def paths_of(conversations: DataFrame, head_of: Column | None = None) -> DataFrame:
    """One row for each rebuilt conversation and depth, from 0: digest (a, b) of the prefix, (pa, pb) of its parent."""
    turns = written(turns_of(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD if head_of is None else head_of
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    convs = written(convs.withColumn("len", F.least("h", "m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("turn")), 256)
    lane = lambda k: F.conv(F.substring(salted, k, 15), 16, 10).cast("bigint")
    rows = rebuilt(turns, convs).withColumns({"x": lane(1), "y": lane(16)}).drop("turn")
    rows = running_xor(rows, convs.agg(F.max("len")).first()[0] or 0)
    rows = rows.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "a", "b", F.expr("a ^ x").alias("pa"), F.expr("b ^ y").alias("pb"), "bytes").join(convs.select("conv_id", "len"), "conv_id")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", *(zero.alias(c) for c in ("depth", "a", "b", "pa", "pb", "bytes")), "len")
    return rows.unionByName(roots)


def ends_of(rows: DataFrame) -> DataFrame:
    """For each digest at which conversations end, the SHA-256 of their ids, ascending and joined by commas."""
    chunks = rows.where("depth = len").groupBy("a", "b", "depth", F.shiftright("conv_id", IDS_POWER).alias("chunk"))
    chunks = chunks.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = StructType.fromDDL("a bigint, b bigint, depth bigint, ends_sha256 string")
    target = arrow_schema(schema)

    def run(batches):
        key = state = None
        for batch in batches:
            done = []
            for a, b, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b, depth) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b, depth), sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, state.hexdigest()), target)], schema=target)

    ordered = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "depth", "chunk").select("a", "b", "depth", "ids")
    return ordered.mapInArrow(run, schema)


KEY = ["a", "b"]


def trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """All nodes with their figures; `paths` is a written table of paths_of()."""
    none = F.lit(0).cast("bigint")
    rows = paths.withColumns({"cnt": F.lit(1).cast("bigint"), "kids": none, "leaves": none, "saved": none})
    finished = []
    while True:
        n = rows.count()
        whole = n <= shard
        if whole:
            light = rows.withColumns({"k": F.lit(-1).cast("bigint"), "top_conv": F.lit(None).cast("bigint"), "ra": none, "rb": none})
        else:
            sums = [F.min("conv_id").alias("owner"), F.min("depth").alias("at"), F.sum(F.col("len") - F.col("depth") + 1).alias("w"), *(F.sum(c).alias(f"v_{c}") for c in ("cnt", "kids", "leaves", "saved"))]
            heavy = written(rows.groupBy(*KEY).agg(*sums).where(F.col("w") > shard))
            deepest = F.max(F.struct("depth", "owner"))
            cuts = written(rows.join(heavy.select(*KEY, "owner"), KEY).groupBy("conv_id").agg(deepest.alias("d")).select("conv_id", F.col("d.depth").alias("k"), F.col("d.owner").alias("top_conv")))
            tops = rows.join(cuts, "conv_id").where("depth = k + 1").select("conv_id", "k", "top_conv", F.col("a").alias("ra"), F.col("b").alias("rb"))
            light = rows.join(tops, "conv_id").where("depth > k")
        nodes = light.groupBy("ra", "rb", "a", "b", "pa", "pb", "depth", "k", "top_conv").agg(
            F.min("conv_id").alias("conv_id"), F.sum("cnt").alias("cnt"), F.max("bytes").alias("bytes"), *(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))
        nodes = nodes.withColumns({"shard": F.pmod(F.xxhash64("ra", "rb"), F.lit(max(1, math.ceil(n / shard)))), "cut": F.col("k") + 1}).drop("k", "ra", "rb")
        finished.append(written(nodes.groupBy("shard").applyInArrow(accumulated, NODE_DDL)))
        if whole:
            break
        sent = finished[-1].where("is_top").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        sent = sent.agg(F.count("*").alias("s_kids"), F.sum("n_leaves").alias("s_leaves"), F.sum("saved_tokens").alias("s_saved"))
        held = heavy.select(F.col("owner").alias("conv_id"), F.col("at").alias("depth"), "v_cnt", "v_kids", "v_leaves", "v_saved")
        above = rows.drop("cnt", "kids", "leaves", "saved", "len").join(heavy.select(F.col("owner").alias("conv_id")).distinct(), "conv_id", "left_semi").join(cuts.select("conv_id", F.col("k").alias("len")), "conv_id").where("depth <= len")
        above = above.join(held, ["conv_id", "depth"], "left").join(sent, ["conv_id", "depth"], "left")
        total = lambda *names: sum((F.coalesce(c, F.lit(0)) for c in names[1:]), F.coalesce(names[0], F.lit(0)))
        rows = written(above.select("conv_id", "depth", "a", "b", "pa", "pb", "bytes", "len", total("v_cnt").alias("cnt"), *(total(f"v_{c}", f"s_{c}").alias(c) for c in ("kids", "leaves", "saved"))))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, head_of: Column | None = None, shard: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node. `head_of`: turns that a conversation takes from its base, under 9."""
    paths = written(paths_of(conversations, head_of))
    nodes = trie(paths, shard).join(ends_of(paths), ["a", "b", "depth"], "left")
    ends = F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = {
    "op11_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, {sql_crc32("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM turns GROUP BY conv_id),
convs AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS m FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.base),
rebuilt AS (
  SELECT conv_id, 0 AS depth, '' AS said, 0 AS bytes FROM convs
  UNION ALL SELECT c.conv_id, p - h + m, said, bytes FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE p > h
  UNION ALL SELECT c.conv_id, p, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.base WHERE p <= h),
paths AS (SELECT *, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM rebuilt),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids
  FROM paths GROUP BY prefix, depth),
linked AS (SELECT n.*, q.prefix AS parent FROM nodes n LEFT JOIN paths q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
kids AS (SELECT parent AS prefix, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT q.prefix, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE k.prefix IS NULL) AS n_leaves
  FROM nodes n JOIN paths q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN kids k ON k.prefix = n.prefix GROUP BY q.prefix)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(n.ids, '')) AS ends_sha256
FROM linked n JOIN below b ON b.prefix = n.prefix LEFT JOIN kids k ON k.prefix = n.prefix LEFT JOIN nodes p ON p.prefix = n.parent
"""
}
