"""Operator 4: documents linked by the Jaccard similarity of their word n-gram sets; size-aware heavy-light join.

A set's elements are in one global order, and a set of n needs to share at least c = ceil(n * share) elements with any
partner. Then two partners have an element in common among their first n - c + 1 elements, and a pair of elements among
their first n - c + 2. Small sets (up to a boundary) enumerate all subsets of two of these and meet where a subset is the
same. Larger sets are posted in inverted lists of single elements, and so are the sets just below the boundary that can
be partners of a larger one. The boundary is the one of the least cost: rows of enumerated subsets against rows and pairs
of scanned lists, counted over all documents.

Frequent elements. Lists of many sets (a passage that many documents share) would give all pairs of these. Elements
that are in many sets' first elements, counted over all documents, go last in the order, so that they leave most sets'
first elements. Counted are twice as many first elements as lead, as what comes in the place of a passage's first
elements is mostly the rest of it. The order is global, so no link is lost whatever is in it; it decides costs alone.
Only the frequent elements' hashes are broadcast: at most `MOST_FREQUENT`, the threshold rising until that holds.
Tasks count what they hold and deal it out by hash, so a group has a bounded share of the elements and no element has
more than a row for each million that a task counted.

Links within a list. Equal sets are one class. In each list and size band, all classes are compared with one pivot; the
links found give components. The pivot is the member that shares most lists with others: an original rather than an
edited copy. Then, in lists that still span components, the members outside of the list's main component are compared
with those of other components. Pairs in one component need no comparison, so a group of m near copies
costs about m comparisons, and no link between different components is missed. A pair is first bounded by parities of both
sets (a bit or two for each element, flipped by each element there is; bits that differ stand for as many elements that
are not common at least), then compared exactly on the sets.

Hot keys. A list, a pivot, a class of copies or a component may be very large. What is counted for each of these is
combined before it is shuffled and written as a table, so that every join on such a key is one of two plain tables, whose
large partitions adaptive execution splits; no join waits in one task for an aggregation on the same key.

Defined results: a text without words (null, empty, blank) has an empty set, no links, and is its own component; fewer
words than the n-gram make one element, the whole sequence; equal sets are linked; every row gives a row, repeated rows
too; rows without an id are linked but don't give a component its id (it is null if no member has one); whole texts are
read; an empty table gives no rows; other columns are ignored. n-grams are compared as 64-bit hashes, sets as 128-bit ones.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BATCH_ROWS, arrow_schema, discard, table, written

#: Sets in a list from which on its element counts as frequent; most frequent elements that are broadcast.
FREQUENT, MOST_FREQUENT = 32, 500_000
#: Bytes of text, about, whose elements one group counts; elements that a task counts before it deals them out.
GROUP_BYTES, COUNTED_AT_ONCE = 1 << 25, 1 << 20
#: Tasks over which a frequent element's list is spread.
SALTS = 64
#: The largest boundary that is tried.
MOST_SMALL = 64
#: Kinds of counted elements: leading ones by the size of their set (the last is for all larger ones), those that follow
#: them, and leading pairs by the size of their set.
LARGE, NEXT, PAIRS = MOST_SMALL + 1, MOST_SMALL + 2, 128
#: Slots of the filter that spares texts without candidates a second look; fixed, 8 MB.
SLOTS = 1 << 26
#: Tokens whose hashes a worker remembers.
MEMO = 200_000

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PAIR_SPACE = np.uint64(0x14057B7EF767814F)


class Tokens(dict):
    """64-bit hashes of tokens, remembered."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def shingle_sets(texts: list[str | None], size: int, tokens: Tokens):
    """The sets of hashed word n-grams of texts, each in ascending order, which is the global order."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = [len(w) for w in words]
    a = np.fromiter((tokens[x] for w in words for x in w), np.uint64, sum(n))
    h = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for k in range(size):
        h = mixed(h * _MUL + a[k : k + len(h)])
    start = 0
    for m in n:
        if m >= size:
            yield distinct(h[start : start + m - size + 1])
        elif m:
            one = np.full(1, m, np.uint64)
            for x in a[start : start + m]:
                one = mixed(one * _MUL + x)
            yield one
        else:
            yield a[:0]
        start += m


def needed(n: int, percent: int) -> int:
    """Elements that a set of n must share with any partner."""
    return -(-n * percent // 100)


def leading(ordered: np.ndarray, percent: int, subset: int) -> np.ndarray:
    """The first elements, among which partners share a subset of so many."""
    return ordered[: len(ordered) - needed(len(ordered), percent) + subset]


def leading_pairs(ordered: np.ndarray, percent: int) -> np.ndarray:
    lead = leading(ordered, percent, 2)
    i, j = np.triu_indices(len(lead), 1)
    return mixed(lead[i] * _MUL + mixed(lead[j] ^ _PAIR_SPACE))


def signatures(ordered: np.ndarray, percent: int, small: int) -> np.ndarray:
    """Lists in which a set is posted: its leading elements, or hashes of its leading pairs, or both near the boundary."""
    n = len(ordered)
    out = []
    if n > 1 and n <= small:
        out.append(leading_pairs(ordered, percent))
    if n > (percent > 50) and 100 * n > percent * small:  # above 50, a set of one has no partner but its equals
        out.append(leading(ordered, percent, 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order: frequent elements last."""
    last = member(frequent, s)
    return np.concatenate([s[~last], s[last]]) if last.any() else s


def parities(s: np.ndarray) -> np.ndarray:
    """Bits, 256 to 8192, one or two for each element of a set if these are enough; each element flips one."""
    size = 1 << min(13, max(8, (len(s) - 1).bit_length()))
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def most_common(a: int, b: int, x: list[int], y: list[int]) -> int:
    """The most elements that sets of sizes a and b with parities x and y can share."""
    p, q = np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64)
    size = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(v.reshape(-1, size), 0) for v in (p, q))
    return min(a, b, (a + b - int(np.bitwise_count(p ^ q).sum())) // 2)


def least_cost(paired: np.ndarray, listed: np.ndarray, percent: int) -> int:
    """The boundary of the least cost, from the costs of sets of each size as pairs and in lists."""
    total = lambda x: paired[: x + 1].sum() + listed[percent * x // 100 + 1 :].sum()
    return min(range(MOST_SMALL + 1), key=lambda x: (total(x), x))


def boundary(texts: list[str], rows: int, size: int, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, for texts in memory that stand for `rows`
    of them; a plain version of what Linker counts over a table."""
    tokens = Tokens()
    sets = [s for s in {x.tobytes(): x for x in shingle_sets(texts, size, tokens)}.values() if len(s) > 1]
    if not sets or percent <= 50:  # below that, partners may share less than a pair
        return 0
    lead = [leading(s, percent, 1) for s in sets]
    _, place, df = np.unique(np.concatenate(lead), return_inverse=True, return_counts=True)
    others = np.split(np.minimum(df[place] - 1, FREQUENT).astype(float), np.cumsum([len(x) for x in lead])[:-1])
    scale = min(max(1.0, rows / len(sets)), FREQUENT)
    listed = np.zeros(MOST_SMALL + 2)
    paired = np.zeros(MOST_SMALL + 2)
    for s, x in zip(sets, others):
        n = min(len(s), MOST_SMALL + 1)
        listed[n] += len(x) + scale * x.sum()
        paired[n] += math.comb(len(x) + 1, 2)
    return least_cost(paired, listed, percent)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_sets(docs: DataFrame, each, schema: str, size: int, percent: int, wanted=None) -> DataFrame:
    """Arrow map over (…, text): `each(columns, sets, seen)` gives the columns of the output from those of a batch.
    `wanted(batch)` takes rows out before; it runs in the same worker, as a second map would hold a second one a task."""
    struct = StructType.fromDDL(schema)
    target = arrow_schema(struct)

    def run(batches):
        np.seterr(over="ignore")
        tokens, seen = Tokens(), set()
        for batch in batches:
            batch = wanted(batch) if wanted else batch
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                cols = [c.to_pylist() for c in part.columns]
                out = list(each(cols[:-1], shingle_sets(cols[-1], size, tokens), seen))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), target)], schema=target)

    return docs.mapInArrow(run, struct)


def counted(s: np.ndarray, percent: int):
    """(kind, elements) of a set that are counted for the order and the boundary."""
    n = len(s)
    if n > (percent > 50):
        lead = len(leading(s, percent, 1))
        yield min(n, LARGE), s[:lead]
        yield NEXT, s[lead : 2 * lead]
        if 1 < n <= MOST_SMALL and percent > 50:
            yield PAIRS + n, leading_pairs(s, percent)


def dealt(held: list[tuple[int, np.ndarray]], groups: int) -> pa.RecordBatch:
    """Counts of (element, kind), packed by the group that an element is in."""
    sigs = np.concatenate([x for _, x in held])
    sigs = (sigs << np.uint64(32)) | (sigs >> np.uint64(32))  # leading elements are the low ones
    kinds = np.repeat(np.array([k for k, _ in held], np.uint8), [len(x) for _, x in held])
    order = np.lexsort((kinds, sigs))
    sigs, kinds = sigs[order], kinds[order]
    at = np.flatnonzero(np.r_[True, (sigs[1:] != sigs[:-1]) | (kinds[1:] != kinds[:-1])])
    counts = np.diff(np.r_[at, len(sigs)]).astype(np.uint32)
    sigs, kinds = sigs[at], kinds[at]
    group = ((sigs >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    cuts = np.searchsorted(group, np.arange(groups + 1).astype(np.uint64))
    some = [(g, i, j) for g, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
    packed = [pa.array([x[i:j].tobytes() for _, i, j in some], pa.binary()) for x in (sigs, kinds, counts)]
    return pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in some], pa.int32()), *packed], names=["part", "sigs", "kinds", "counts"])


def tallies(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Over all (text): (sig, c) of elements and pairs that are in FREQUENT sets' counted ones at least, c times; and rows
    without sig for each set size n up to MOST_SMALL, of what such sets cost in lists and as pairs. Sets are counted once a task."""
    groups = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES
    frequent, at_once = FREQUENT, COUNTED_AT_ONCE
    schema = StructType.fromDDL("sig bigint, c bigint, n int, listed double, paired double")
    target = arrow_schema(schema)

    def deal(batches):
        np.seterr(over="ignore")
        tokens, seen, held, amount = Tokens(), set(), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                for s in shingle_sets(batch.column(0).slice(start, BATCH_ROWS).to_pylist(), size, tokens):
                    if (mark := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                        continue
                    seen.add(mark)
                    for kind, x in counted(s, percent):
                        held.append((kind, x.copy()))
                        amount += len(x)
                    if amount >= at_once:
                        yield dealt(held, groups)
                        held, amount = [], 0
        if amount:
            yield dealt(held, groups)

    def add(group: pa.Table) -> pa.Table:
        sigs, kinds, counts = (np.frombuffer(b"".join(group.column(name).to_pylist()), kind) for name, kind in (("sigs", np.uint64), ("kinds", np.uint8), ("counts", np.uint32)))
        order = np.argsort(sigs, kind="stable")
        sigs, kinds, counts = sigs[order], kinds[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        lead = np.where(kinds <= LARGE, counts, 0)
        others = np.repeat(np.minimum(np.add.reduceat(lead, at) - 1, frequent), np.diff(np.r_[at, len(sigs)]))
        small, pair = kinds <= MOST_SMALL, kinds >= PAIRS
        listed = np.bincount(kinds[small], (lead * (1 + others))[small], MOST_SMALL + 1)
        paired = np.bincount(kinds[pair] - PAIRS, counts[pair], MOST_SMALL + 1)
        c = np.add.reduceat(counts, at)
        hot = np.flatnonzero(c >= frequent)
        back = (sigs[at[hot]] << np.uint64(32)) | (sigs[at[hot]] >> np.uint64(32))
        none = [None] * len(hot)
        columns = [[*signed(back).tolist(), *[None] * len(listed)], [*c[hot].tolist(), *[None] * len(listed)], [*none, *range(len(listed))], [*none, *listed.tolist()], [*none, *paired.tolist()]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, target)], schema=target)

    packed = docs.select("text").mapInArrow(deal, "part int, sigs binary, kinds binary, counts binary")
    return packed.groupBy("part").applyInArrow(add, schema)


def repeated(posted: DataFrame) -> DataFrame:
    """Of (sig, key, n), the rows of lists of two classes or more; n is negative in lists of frequent elements.

    The rows are dealt by list and sorted; runs are read as a stream, so a list of any length takes no memory. Lists of
    frequent elements are spread over several tasks, and all of their rows stay."""
    schema = StructType.fromDDL("sig bigint, key bigint, n int")
    target = arrow_schema(schema)

    def run(batches):
        last = held = None  # the last row; that row again while it is the only one of its list
        for batch in batches:
            sig, key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            new[0] = last is None or (sig[0], key[0]) != last
            sig, key, n = sig[new], key[new], n[new]
            if not len(sig):
                continue
            same = sig[1:] == sig[:-1]
            keep = np.r_[last is not None and sig[0] == last[0], same] | np.r_[same, False] | (n < 0)
            rows = [sig[keep], key[keep], np.abs(n[keep])]
            if held is not None and sig[0] == held[0]:
                rows = [np.r_[np.array([h], r.dtype), r] for h, r in zip(held, rows)]
            last = (sig[-1], key[-1])
            held = None if keep[-1] else (sig[-1], key[-1], n[-1])
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, target)], schema=target)

    salt = F.when(F.col("n") < 0, F.pmod("key", F.lit(SALTS))).otherwise(0)
    return posted.repartition("sig", salt).sortWithinPartitions("sig", "key").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for all nodes of links (a, b). Least neighbours, then labels of labels,
    which halves the distances; each round is written to the shared folder, and the one before is removed."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = written(step.join(jump, "to").select("node", "old", F.least("to", "far").alias("label")))
        discard(labels)
        labels = after
        if after.where("label <> old").isEmpty():
            discard(edges)
            return after.select("node", "label")


@contextmanager
def step_settings(spark: SparkSession):
    """Settings for what is run within: Arrow batches of few rows, as a row may hold a long text or two sets; a query's shuffle
    files go once it has ended, as each step is a table by then."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in now}
    for name, value in now.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Linker:
    """One join: the parameters, and the tables that its steps share."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        text = F.col(text_col)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        self.tallies = written(tallies(self.docs, size, percent))
        costs = self.tallies.where("n IS NOT NULL").groupBy("n").agg(F.sum("paired").alias("paired"), F.sum("listed").alias("listed")).collect()
        paired, listed = np.zeros(MOST_SMALL + 1), np.zeros(MOST_SMALL + 1)
        for r in costs:
            paired[r["n"]], listed[r["n"]] = r["paired"], r["listed"]
        self.small = least_cost(paired, listed, percent) if percent > 50 else 0  # below that, partners may share less than a pair

    def frequent(self) -> np.ndarray:
        """Hashes of frequent elements (and leading pairs), sorted; at most MOST_FREQUENT."""
        least, counts = FREQUENT, self.tallies.where("sig IS NOT NULL")
        steps = {r["power"]: r["count"] for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().collect()}
        while sum(n for power, n in steps.items() if 2 ** (power + 1) > least) > MOST_FREQUENT:
            least *= 2
        hot = [r[0] for r in counts.where(F.col("c") >= least).select("sig").toLocalIterator()]
        discard(self.tallies)
        return np.sort(np.array(hot, np.int64).view(np.uint64))

    def rows(self) -> DataFrame:
        """doc_id, text_key, key (64 bits of the set), set_key (128 bits), n, and once for each class and task its
        parities and signatures, negative n marking those of frequent elements."""
        percent, small = self.percent, self.small
        shared = self.spark.sparkContext.broadcast(self.frequent())

        def each(cols, sets, seen):
            for doc_id, text_key, s in zip(*cols, sets):
                set_key = xxhash.xxh3_128_digest(s.tobytes())
                key = int.from_bytes(set_key[:8], "big", signed=True)
                fresh = set_key not in seen
                seen.add(set_key)
                sigs = signatures(ordered(s, shared.value), percent, small) if fresh else None
                yield doc_id, text_key, key, set_key, len(s), parities(s) if fresh else None, signed(sigs) if fresh else None, member(shared.value, sigs) if fresh else None

        return map_sets(self.docs, each, "doc_id bigint, text_key bigint, key bigint, set_key binary, n int, bits array<bigint>, sigs array<bigint>, hot array<boolean>", self.size, percent)

    def lists(self, rows: DataFrame) -> DataFrame:
        """(sig, key, n): every list of two classes or more that can hold partners."""
        posted = rows.where(F.size("sigs") > 0).select("key", "n", F.explode(F.arrays_zip("sigs", "hot")).alias("s"))
        return repeated(posted.select(F.col("s.sigs").alias("sig"), "key", F.when(F.col("s.hot"), -F.col("n")).otherwise(F.col("n")).alias("n")))

    def sets_of(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """(key, set_key, elements) of the classes with these keys, from one text of each."""
        keys = written(keys.distinct())
        one = rows.join(keys, "key", "left_semi").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
        slot = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SLOTS))
        words = one.select(F.pmod(F.xxhash64("r.doc_id", "r.text_key"), F.lit(SLOTS)).alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        bits = np.zeros(SLOTS // 64, np.int64)
        for r in words.toLocalIterator():
            bits[r["word"]] = r["bits"]
        shared = self.spark.sparkContext.broadcast(bits.view(np.uint8))

        def wanted(batch):
            at = batch.column(0).to_numpy()
            return batch.filter(pa.array(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))

        def each(cols, sets, seen):
            for s in sets:
                set_key = xxhash.xxh3_128_digest(s.tobytes())
                if set_key not in seen:
                    seen.add(set_key)
                    yield int.from_bytes(set_key[:8], "big", signed=True), set_key, s.tobytes()

        texts = self.docs.select(slot.alias("slot"), "text")
        found = map_sets(texts, each, "key bigint, set_key binary, elements binary", self.size, self.percent, wanted)
        out = written(found.join(keys, "key", "left_semi").dropDuplicates(["set_key"]))
        discard(keys)
        return out

    def linked(self, pairs: DataFrame, rows: DataFrame, bits: DataFrame) -> DataFrame:
        """Of pairs of keys (x, y), the linked pairs of sets (a, b): bounded by parities, then compared exactly."""
        percent = self.percent
        both = pairs.join(bits.toDF("x", "n", "p"), "x").join(bits.toDF("y", "m", "q"), "y").select("x", "y", "n", "m", "p", "q")

        def possible(batches):
            for batch in batches:
                n, m, p, q = (batch.column(c).to_pylist() for c in range(2, 6))
                common = [most_common(*v) for v in zip(n, m, p, q)]
                ok = [100 * c >= percent * (a + b - c) for c, a, b in zip(common, n, m)]
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok, pa.bool_())).columns[:2], names=["x", "y"])

        left = written(both.mapInArrow(possible, "x bigint, y bigint"))
        sets = self.sets_of(rows, left.select(F.col("x").alias("key")).unionByName(left.select(F.col("y").alias("key"))))
        a = sets.select(F.col("key").alias("x"), F.col("set_key").alias("a"), F.col("elements").alias("ea"))
        b = sets.select(F.col("key").alias("y"), F.col("set_key").alias("b"), F.col("elements").alias("eb"))

        def exact(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                    common = int(member(p, q).sum())
                    ok.append(100 * common >= percent * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok, pa.bool_())).columns[:2], names=["a", "b"])

        out = written(left.join(a, "x").join(b, "y").select("a", "b", "ea", "eb").mapInArrow(exact, "a binary, b binary"))
        discard(left, sets)
        return out

    def fits(self, m: str, n: str):
        """Whether sizes allow a link."""
        return (F.col(m) * 100 >= F.col(n) * self.percent) & (F.col(n) * 100 >= F.col(m) * self.percent)

    def scored(self, lists: DataFrame) -> DataFrame:
        """The lists with an order in which members come that share most with others: the sum of the sizes of all their
        lists. An original precedes its edited copies, which are more like it than like each other."""
        sizes = written(lists.groupBy("sig").agg(F.count("*").alias("m")))
        score = lists.join(sizes, "sig").groupBy("key").agg((-F.sum("m")).alias("score"))
        out = written(lists.join(score, "key").select("sig", "key", "n", F.struct("score", F.xxhash64("key").alias("h")).alias("o")))
        discard(lists, sizes)
        return out

    def pivot_pairs(self, lists: DataFrame) -> DataFrame:
        """Each list member with the pivot of its list and size band; the pivot order is the same in all lists."""
        band = F.floor(F.log("n") / math.log(100 / self.percent)).cast("int") if self.percent < 100 else F.col("n")
        banded = lists.withColumn("band", band)
        pivots = written(banded.groupBy("sig", "band").agg(F.min(F.struct("o", "key", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("sig", "band", F.col("p.key").alias("y"), F.col("p.n").alias("m")))
        near = banded.join(pivots, ["sig", "band"])
        out = written(near.where((F.col("key") != F.col("y")) & self.fits("n", "m")).select(F.least("key", "y").alias("x"), F.greatest("key", "y").alias("y")).distinct())
        discard(pivots)
        return out

    def spanning(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """(sig, key, n, o, label, main): the lists that span components, with the component that has most of each."""
        labels = components(links).select(self.key_of("node").alias("key"), self.key_of("label").alias("label")).groupBy("key").agg(F.min("label").alias("label"))
        named = lists.join(labels, "key", "left").withColumn("label", F.coalesce("label", F.col("key")))
        counts = named.groupBy("sig", "label").agg(F.count("*").alias("c"))
        mains = written(counts.groupBy("sig").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("sig", F.col("m.label").alias("main")))
        out = written(named.join(mains, "sig"))
        discard(mains)
        return out

    def possible(self) -> Column:
        """Whether parities p and q of sets of m and n elements leave a link possible; those of different length are left for
        later. Where d elements are not common, 100 times the m + n - d of both sets' common ones is `percent` of all m + n + d."""
        differing = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = (F.col("m") + F.col("n")).cast("bigint")
        return F.when(F.size("p") == F.size("q"), (both - differing) * 100 >= (both + differing) * self.percent).otherwise(True)

    def rest_pairs(self, spanning: DataFrame, bits: DataFrame) -> DataFrame:
        """Members outside of a list's main component with members of other components, as far as parities allow it."""
        spanning = spanning.join(bits.select("key", "bits"), "key")
        rest = spanning.where("label <> main").select(F.col("sig").alias("list"), F.col("key").alias("x"), F.col("n").alias("m"), F.col("label").alias("lx"), F.col("bits").alias("p"))
        every = spanning.select("sig", F.col("key").alias("y"), "n", F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("in_main"), F.col("bits").alias("q"))
        same = F.col("lx") == F.col("ly")
        met = rest.join(every, (F.col("list") == F.col("sig")) & ~same & (F.col("in_main") | (F.col("x") < F.col("y"))) & self.fits("m", "n") & self.possible())
        return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def links(self, rows: DataFrame, lists: DataFrame, bits: DataFrame) -> DataFrame:
        """Links (a, b) between different sets that connect what is connected."""
        lists = self.scored(lists)
        pairs = self.pivot_pairs(lists)
        found = self.linked(pairs, rows, bits)
        spanning = self.spanning(lists, found)
        rest = written(self.rest_pairs(spanning, bits).join(pairs, ["x", "y"], "left_anti"))
        discard(lists, pairs, spanning)
        if not rest.isEmpty():
            found = found.unionByName(self.linked(rest, rows, bits))
        discard(rest, bits)
        return found

    @staticmethod
    def key_of(set_key: str):
        """A number for a set within one run of the join: the 64 bits that rows() takes as its key."""
        return F.expr(f"cast(conv(hex(substring({set_key}, 1, 8)), 16, -10) as bigint)")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that is reachable by links."""
    with step_settings(docs.sparkSession):
        linker = Linker(docs, size, percent, id_col, text_col)
        wide = written(linker.rows())
        lists, bits = written(linker.lists(wide)), written(wide.where("bits IS NOT NULL").select("key", "n", "bits").dropDuplicates(["key"]))
        rows = written(wide.select("doc_id", "text_key", "key", "set_key", "n"))
        discard(wide)
        labels = components(linker.links(rows, lists, bits)).select(F.col("node").alias("set_key"), "label")
        classes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
        linked = written(labels.join(classes, "set_key"))
        least = written(linked.groupBy("label").agg(F.min("least").alias("of_links")))
        by_links = linked.join(least, "label").select("set_key", "of_links", F.lit(True).alias("links"))
        by_set = written(classes.join(by_links, "set_key", "left").select("set_key", F.when(F.col("links"), F.col("of_links")).otherwise(F.col("least")).alias("component_id")))
        discard(linked, least)
    out = rows.select("doc_id", "n", "set_key").join(by_set, "set_key", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row of the least id stays (rows without an id
    come last, then the first row), and every row without words. The row numbers are written once with the rows, as they
    follow the partitions of a scan, which change with the executors that are alive."""
    columns, row = docs.columns, f"row_{uuid.uuid4().hex}"
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = similar_documents(docs, size, percent, row, text_col).withColumnRenamed("doc_id", row)
    named = groups.join(docs.select(row, F.col(id_col).alias("id")), row)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("first"))
    return docs.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
