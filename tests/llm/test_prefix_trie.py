import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.llm import prefix_trie as T

from ..helpers import SF

KEYS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
DDL = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted(tuple(r[k] for k in KEYS) for r in df.collect())


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def sample(seed, convs=300):
    """Few texts, so that prefixes are shared at all depths; a hot first turn, copies, one long conversation, gaps in ids."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 2 * convs), convs):
        hot = rnd.random() < 0.5
        for t in range(rnd.choice((1, 2, 3, 8, 12))):
            rows.append((c, t, "user", "hello" if hot and t < 4 else rnd.choice(("a", "b", "é", ""))))
    rows += [(1000, t, "assistant", f"long {t}") for t in range(500)] + [(1001, t, "assistant", f"long {t}") for t in range(490)]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(T.op11_prefix_trie(spark, SF)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("shard", [1, 40, 700, 10**6])
def test_rounds(spark, shard):
    """Small shards: several rounds, each above the one before; all give the same nodes."""
    rows = sample(5, 60 if shard == 1 else 300)
    if shard == 1:
        rows = [r for r in rows if r[0] < 1000]
    assert got(T.prefix_trie(frame(spark, rows), shard=shard)) == brute(rows)


def test_long_conversations_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "WINDOW_TURNS", 7)
    rows = sample(6, 80)
    assert got(T.prefix_trie(frame(spark, rows), shard=100)) == brute(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, None, "", ""), (7, 0, "user", "y" * 400_000), (-3, 2, "u", "é"), (-3, 2, "u", "é"), (8, 3, None, "q")]
    df = frame(spark, [(*r, 1, "z") for r in rows], DDL + ", a int, depth string")
    assert got(T.prefix_trie(df)) == brute(rows)
    assert got(T.prefix_trie(df.limit(0))) == [] == brute([])


def test_many_ids_end_at_a_node(spark):
    df = spark.range(-3000, 5000).select(F.col("id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    assert got(T.prefix_trie(df, shard=50)) == brute([tuple(r) for r in df.collect()])


def test_slot_table():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 60, (2, 20_000))
    table = T.SlotTable(a[:15_000], b[:15_000])
    assert sorted(table.slots(a[:15_000], b[:15_000])) == list(range(15_000))
    assert (table.slots(a[15_000:], b[15_000:]) == -1).all()
    assert (table.slots(a[:15_000], b[:15_000] ^ 1) == -1).all()
    assert len(T.SlotTable(a[:0], b[:0]).slots(a[:5], b[:5])) == 5
    with pytest.raises(ValueError):
        T.SlotTable(np.array([3, 3]), np.array([4, 4]))
