"""Operator 13: Merkle manifest of a dataset by time-forward processing.

Nodes of a tree are labelled (level, index), an order in which children come before parents. A sweep in label order takes
the digests that were sent to each label from a priority queue, hashes them and sends the result to the parent's label; a
sweep in the reversed order sends each node's proof suffix (its siblings and all above) to its children, down to the
leaves. A task runs both sweeps over a block of `RUN ** LEVELS` neighbouring leaves with a queue that is no larger than
the block. The queue's external part is Spark's shuffle: what a block sends to labels outside of it is a row, sorted and
spilled by the shuffle and delivered to the block of that label in the next round. So a tree of n leaves takes
log(n) / log(RUN ** LEVELS) rounds (four for 10^10 leaves), each over 1/512 of the rows of the one before, and only
digests are moved, never texts.

Leaves are ranked within their language by one range-partitioned sort, so a language with any share of the rows is spread
over many blocks. The subroots of the languages form one more tree, by the same code.

Defined results: nulls are hashed as `-`; a null id comes first and is never tampered with; rows with the same id go by
their leaf's digest, and equal rows are leaves of their own; an empty table gives no rows; other columns are ignored;
languages are ordered bytewise, null first.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, sql_crc32, table, written

#: Nodes of a run, and levels of a block.
RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Between the siblings to the left and those to the right of a node, and after those of a level.
SIDE, END = "|", ";"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(source: Column, doc_id: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def up(leaves: list[str], levels: int | None) -> list[list[str]]:
    """Digests of each level of a block over its leaves: so many levels more, or up to a single node if that is None."""
    nodes = [leaves]
    queue = [(1, k // RUN, k, h) for k, h in enumerate(leaves)] if levels or levels is None and len(leaves) > 1 else []
    heapq.heapify(queue)
    while queue:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        if len(nodes) == level:
            nodes.append([])
        nodes[level].append(digest("".join(children)))
        last = len(nodes[level]) == -(-len(nodes[level - 1]) // RUN)  # the level is whole
        if level == levels or levels is None and last and len(nodes[level]) == 1:
            continue
        heapq.heappush(queue, (level + 1, index // RUN, index, nodes[level][index]))
    return nodes


def down(nodes: list[list[str]], suffix: str) -> list[str]:
    """The proof suffix of every leaf of a block, given that of its top."""
    top = len(nodes) - 1
    queue = [(-top, k, suffix) for k in range(len(nodes[top]))]
    out = []
    while queue:
        level, index, suffix = heapq.heappop(queue)
        if not level:
            out.append(suffix)
            continue
        children = nodes[-level - 1][index * RUN : index * RUN + RUN]
        for k in range(len(children)):
            own = "".join(children[:k]) + SIDE + "".join(children[k + 1 :]) + END
            heapq.heappush(queue, (level + 1, index * RUN + k, own + suffix))
    return out


def folded(leaf: str, suffix: str) -> str:
    """The root that a leaf and its proof give."""
    for level in suffix.split(END)[:-1]:
        left, right = level.split(SIDE)
        leaf = digest(left + leaf + right)
    return leaf


NODE = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
PROOF = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("suffix", pa.string())])
PROOF_DDL = "tree string, idx bigint, subroot string, root string, suffix string"


def in_block(rows: pa.Table) -> list[list[str]]:
    """The levels of a block; its rows are sorted by place."""
    n = rows.column("n")[0].as_py()
    return up(rows.column("digest").to_pylist(), LEVELS if n > BLOCK else None)


def blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).groupBy("tree", "block")


def lifted(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks, as the nodes of the next round."""

    def of(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        row = [[block.column("tree")[0].as_py()], [block.column("block")[0].as_py()], [-(-block.column("n")[0].as_py() // BLOCK)], [in_block(block)[-1][0]]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, NODE)], schema=NODE)

    return blocks(nodes).applyInArrow(of, "tree string, idx bigint, n bigint, digest string")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, from all leaves to one node a tree."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(written(lifted(out[-1])))
        most = -(-most // BLOCK)
    return out


def delivered(nodes: DataFrame, proofs: DataFrame) -> DataFrame:
    """The proofs of the nodes of a round, given those of the next."""

    def of(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        got = above.to_pylist()[0]
        suffixes = down(in_block(block), got["suffix"])
        n = len(suffixes)
        columns = [block.column("tree"), block.column("idx"), [got["subroot"]] * n, [got["root"]] * n, suffixes]
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, PROOF)], schema=PROOF)

    return blocks(nodes).cogroup(proofs.groupBy("tree", "idx")).applyInArrow(of, PROOF_DDL)


LEAF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
LEAF_DDL = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(leaves: DataFrame, proofs: DataFrame) -> DataFrame:
    """The manifest's rows: leaves with their proofs, and what each leaf as found now folds to."""

    def of(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        got = above.to_pylist()[0]
        suffixes = down(in_block(block), got["suffix"])
        roots = [folded(h, s) for h, s in zip(block.column("found").to_pylist(), suffixes)]
        proofs_ = [digest(s.replace(SIDE, "").replace(END, "")) for s in suffixes]
        n = len(roots)
        columns = [block.column("doc_id").to_pylist(), block.column("digest").to_pylist(), [got["subroot"]] * n, [got["root"]] * n, proofs_, roots, [r == got["root"] for r in roots]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LEAF)], schema=LEAF)

    return blocks(leaves).cogroup(proofs.groupBy("tree", "idx")).applyInArrow(of, LEAF_DDL)


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """Per row of `docs` (columns doc_id, source, lang, n_chars, text) its leaf, subroot, root and the digest of its proof,
    and whether the row as found now, with `found_text` for its text, still folds to the root."""
    parts = ("source", "doc_id", "lang", "n_chars")
    text = F.col("text")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), leaf_of(*map(F.col, parts), text).alias("digest"),
                         leaf_of(*map(F.col, parts), text if found_text is None else found_text).alias("found"), F.monotonically_increasing_id().alias("row"))
    leaves = written(ranked(written(leaves), "tree", ["doc_id", "digest", "row"], ("row",)))
    by_lang = rounds(leaves)
    subroots = written(ranked(by_lang[-1].select(F.lit("").alias("all"), F.col("tree").alias("lang_tree"), F.col("digest")), "all", ["lang_tree"]).withColumnRenamed("all", "tree"))
    over_langs = rounds(subroots)

    top = F.col("digest")
    proofs = over_langs[-1].select("tree", "idx", top.alias("subroot"), top.alias("root"), F.lit("").alias("suffix"))
    for nodes in reversed(over_langs[:-1]):
        proofs = delivered(nodes, proofs)
    proofs = proofs.join(subroots.select("tree", "idx", "lang_tree", "digest"), ["tree", "idx"])
    proofs = proofs.select(F.col("lang_tree").alias("tree"), F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("subroot"), "root", "suffix")
    for nodes in reversed(by_lang[1:-1]):
        proofs = delivered(nodes, proofs)
    return proved(leaves, proofs)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def sql_tree(name: str, leaves: str, tree: str) -> str:
    """All nodes of the trees over (tree, idx, n, h)."""
    return f"""{name} AS (
  SELECT {tree}, 0 AS level, idx, n, h FROM {leaves}
  UNION ALL SELECT {tree}, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY {tree}, level, idx // 8, n)"""


def sql_fold(name: str, start: str, nodes: str, tree: str) -> str:
    """Each row's way up: what it folds to (h), and its siblings so far (proof)."""
    return f"""{name} AS (
  SELECT id, {tree}, 0 AS level, idx, n, h, proof FROM {start}
  UNION ALL
  SELECT f.id, f.{tree}, f.level + 1, f.idx // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.h ELSE u.h END, '' ORDER BY u.idx)),
    f.proof || coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx <> f.idx), '')
  FROM {name} f JOIN {nodes} u ON u.{tree} IS NOT DISTINCT FROM f.{tree} AND u.level = f.level AND u.idx // 8 = f.idx // 8
  WHERE f.n > 1 GROUP BY f.id, f.{tree}, f.level, f.idx, f.n, f.h, f.proof)"""


ORACLE_SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {sql_leaf("text")} AS leaf,
    {sql_leaf(f"CASE WHEN {sql_crc32('doc_id')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS found
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, leaf AS h
  FROM hashed),
{sql_tree("nodes", "leaves", "lang")},
subroots AS (SELECT 0 AS all_langs, lang, h AS subroot, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{sql_tree("tops", "subroots", "all_langs")},
starts AS (SELECT id, lang, idx, n, found AS h, '' AS proof FROM leaves),
{sql_fold("in_lang", "starts", "nodes", "lang")},
over_langs AS (SELECT f.id, 0 AS all_langs, s.idx, s.n, f.h, f.proof FROM in_lang f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1),
{sql_fold("in_all", "over_langs", "tops", "all_langs")}
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN in_all f ON f.id = l.id AND f.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
}
