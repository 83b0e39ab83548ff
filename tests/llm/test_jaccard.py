import random
import re

import numpy as np
import pytest

from strandloom.llm import jaccard as J

from ..helpers import SF


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(docs, size=5, percent=80):
    """All pairs by an inverted index of whole sets; components by search."""
    sets = []
    for doc_id, text in docs:
        words = re.findall("[^\\x20\\x09-\\x0D]+", ascii_lower(text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    inverted = {}
    for k, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    near = [set() for _ in docs]
    for k, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in inverted[x]:
                counts[j] = counts.get(j, 0) + 1
        near[k] = {j for j, c in counts.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)}
    out, seen = [None] * len(docs), set()
    for k in range(len(docs)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [docs[j][0] for j in group if docs[j][0] is not None]
        for j in group:
            out[j] = (docs[j][0], len(sets[j]), docs[j][0] if not sets[j] else min(ids, default=None))
    return sorted(out, key=repr)


def joined(spark, docs, **more):
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, component_id int")
    return sorted(map(tuple, J.similar_documents(df, **more).collect()), key=repr)


def corpus(seed, n):
    """Texts with near copies in chains, copies, shared passages and short sets."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    out = []
    while len(out) < n:
        base = [rnd.choice(words) for _ in range(rnd.choice([2, 4, 6, 9, 12, 15, 25, 60, 120]))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 0, 1, 3, 12])):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            if rnd.random() < 0.3:
                base = base[:-1] or base
            out.append(" ".join(base).upper() if rnd.random() < 0.1 else " ".join(base))
        if rnd.random() < 0.3:
            out[-1] += " " + passage
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("frequent", [3, 32])
def test_equals_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    docs = corpus(frequent, 700)
    assert joined(spark, docs) == brute(docs)


def test_other_sizes(spark):
    docs = corpus(5, 200)
    assert joined(spark, docs, size=3, percent=60) == brute(docs, 3, 60)
    assert joined(spark, docs, size=2, percent=40) == brute(docs, 2, 40)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert joined(spark, docs) == brute(docs)


@pytest.mark.parametrize("small", [0, 12, 30])
def test_partners_share_a_signature(small):
    rng = np.random.default_rng(small)
    for _ in range(3000):
        a = np.unique(rng.integers(0, 60, rng.integers(2, 45)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 60, 2).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if len(a) > 1 and len(b) > 1 and 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(J.signatures(a, 80, small), J.signatures(b, 80, small)))


def test_boundary_follows_costs():
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    unlike = [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(300)]
    alike = [" ".join(["a b c d e f g h i j k l m n"] + [rnd.choice(words) for _ in range(2)]) for _ in range(300)]
    assert J.boundary(unlike, 300, 5, 80) < J.boundary(alike, 3000, 5, 80)


def test_boundary_at_scale(spark):
    """Both branches are in use on the tenth-scale table; the boundary of the smaller one is 0, so that it has lists alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    linker = J.Linker(docs, 5, 80, "doc_id", "text")
    sizes = [len(s) for s in J.shingle_sets([r.text for r in docs.select("text").collect()], 5, J.Tokens())]
    pairs, lists = sum(1 < n <= linker.small for n in sizes), sum(100 * n > 80 * linker.small for n in sizes)
    assert 10 <= linker.small <= J.MOST_SMALL and pairs > 100 and lists > 5000
    assert J.Linker(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 5, 80, "doc_id", "text").small == 0


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert J.similar_documents(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).count() == 1
    assert spark.conf.get(name) == before


def test_edge_rows(spark):
    text = " ".join(f"t{k}" for k in range(50))
    docs = [(1, None), (2, ""), (3, " \n"), (None, text), (4, text + " x"), (4, text + " x"), (None, "lone words here"), (5, "a b"), (6, "A  b"), (7, "a c"), (8, text * 3000)]
    assert joined(spark, docs) == brute(docs)
    assert joined(spark, []) == []


def test_one_of_each_when_partitions_change(spark, tmp_path, monkeypatch):
    """Other partitions in every later scan, as after the loss of an executor."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(30)) for _ in range(60)]
    docs = [(k, texts[k % 60]) for k in range(240)]
    rnd.shuffle(docs)
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/d")
    size, real = iter(range(10**6)), J.written

    monkeypatch.setattr(J, "discard", lambda *_: None)

    def changed(df):
        out = real(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1500 + 1500 * (next(size) % 5)))
        return out

    monkeypatch.setattr(J, "written", changed)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        out = J.one_of_each(spark.read.parquet(f"{tmp_path}/d")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.doc_id, r.text) for r in out) == sorted((k, texts[k]) for k in range(60))


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 77, 5), (2, "a b c d e f", 78, 6)], "doc_id bigint, text string, _strandloom_row bigint, row bigint")
    assert [tuple(r) for r in J.one_of_each(df).collect()] == [(1, "a b c d e f", 77, 5)]


def all_texts(seed):
    """Long texts first, then short ones that are alike, more than any sample of the first rows has."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    long = [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(2100)]
    return long + [" ".join(["a b c d e f g h i j k l m n"] + [rnd.choice(words) for _ in range(2)]) for _ in range(900)]


def test_boundary_and_frequent_elements_follow_all_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "COUNTED_AT_ONCE", 5000)
    monkeypatch.setattr(J, "GROUP_BYTES", 200_000)
    texts = all_texts(2)
    linker = J.Linker(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), 5, 80, "doc_id", "text")
    assert linker.small == J.boundary(texts, 0, 5, 80) > 0 == J.boundary(texts[:2000], 0, 5, 80)
    counts = {}
    for s in {x.tobytes(): x for x in J.shingle_sets(texts, 5, J.Tokens())}.values():
        first = s[: 2 * len(J.leading(s, 80, 1))]
        for x in np.concatenate([first, J.leading_pairs(s, 80)] if len(s) <= J.MOST_SMALL else [first]).tolist():
            counts[x] = counts.get(x, 0) + 1
    assert linker.frequent().tolist() == sorted(x for x, c in counts.items() if c >= J.FREQUENT) != []


def test_parities_bound_what_is_common():
    """Never below what sets share; below 80 per cent for unlike sets, also for sets just below a size; two bits for an element at most from 128 on."""
    rng = np.random.default_rng(4)
    for n in [*range(40), 63, 64, 100, 127, 128, 255, 256, 500, 511, 512, 3000, 9000]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        part = np.unique(np.r_[s[rng.random(n) > 0.1], rng.integers(0, 2**63, n // 20).astype(np.uint64)])
        other = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        bits = J.parities(s)
        assert J.most_common(len(s), len(part), bits.tolist(), J.parities(part).tolist()) >= len(np.intersect1d(s, part))
        assert 64 * len(bits) <= max(256, 2 * n)
        if n >= 100:
            assert J.most_common(n, n, bits.tolist(), J.parities(other).tolist()) < J.needed(2 * n, 80) / 1.8


def test_steps_remove_their_shuffle_files(spark, monkeypatch):
    """Every step is written while Spark removes the shuffle files of ended queries; the session keeps its own setting."""
    name, at, real = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], J.written
    before = spark.conf.get(name)

    def watched(df):
        at.append(spark.conf.get(name))
        return real(df)

    monkeypatch.setattr(J, "written", watched)
    J.similar_documents(spark.createDataFrame(corpus(1, 30), "doc_id bigint, text string")).count()
    assert set(at) == {"true"} and spark.conf.get(name) == before
