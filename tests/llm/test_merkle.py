import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from strandloom.llm import merkle as M

from ..helpers import SF

DDL = "doc_id bigint, source string, lang string, n_chars bigint, text string"
KEYS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(leaves):
    """The top, and for each leaf its siblings to the left and right, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i // 8 * 8
            path.append((level[run:i], level[i + 1 : run + 8]))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([x[2] for x in sorted(langs[v], key=lambda x: x[:3])]) for v in names}
    root, tops = tree([trees[v][0] for v in names]) if names else (None, [])
    out = []
    for v, top in zip(names, tops):
        for (_, _, own, r), path in zip(sorted(langs[v], key=lambda x: x[:3]), trees[v][1]):
            path = path + top
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate(str.maketrans(M.UPPER, M.LOWER))
            fold = leaf(r, text)
            for left, right in path:
                fold = h(*left, fold, *right)
            out.append((r["doc_id"], own, trees[v][0], root, h(*(x for left, right in path for x in left + right)), fold, fold == root))
    return out


def got(df):
    return sorted((tuple(r[k] for k in KEYS) for r in df.collect()), key=str)


def query(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return M.op13_merkle_manifest(spark, str(tmp_path))


def test_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(M.op13_merkle_manifest(spark, SF))
    assert found == sorted(brute(rows), key=str)
    assert {r[-1] for r in found} == {True, False}


def test_more_rounds_and_many_languages(spark, tmp_path):
    """Over 512 leaves of a language, runs of one node at several levels, and over 512 languages."""
    rows = [{"doc_id": k, "source": "s", "lang": "en", "n_chars": k, "text": f"Text {k}"} for k in range(4097 + 513)]
    rows += [{"doc_id": -k, "source": None, "lang": f"x{k % 600}", "n_chars": None, "text": f"ÉT {k}"} for k in range(900)]
    assert got(query(spark, spark.createDataFrame([tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in rows], DDL), tmp_path)) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 64, 65, 512, 513])
def test_sweeps_equal_plain_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    if not n:
        return
    nodes = M.up(leaves, None)
    top, paths = tree(leaves)
    assert nodes[-1] == [top]
    suffixes = M.down(nodes, "")
    assert suffixes == ["".join("".join(a) + M.SIDE + "".join(b) + M.END for a, b in p) for p in paths]
    assert all(M.folded(x, s) == top for x, s in zip(leaves, suffixes))


def test_fixed_levels_hash_single_nodes():
    assert M.up(["a"], 3)[-1] == [h(h(h("a")))]


def test_edge_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (3, "a", None, 1, "ABC"), (3, "a", None, 1, "ABC"), (3, "a", None, 2, "X"), (5, "", "", 0, ""), (6, "b", "en", 9, "A" * 300_000), (None, "b", "en", 9, "Q")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], DDL + ", row string, tree int")
    assert got(query(spark, df, tmp_path)) == sorted(brute([dict(zip(df.columns, r)) for r in rows]), key=str)


def test_empty_table(spark, tmp_path):
    assert got(query(spark, spark.createDataFrame([], DDL), tmp_path)) == []
