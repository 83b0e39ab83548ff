import random

from strandloom.llm import packing as K

from ..helpers import SF


def plain(sizes, lengths):
    """The same packing with a search of all bins."""
    rest, bins, out = sum(sizes), [], []
    for size in sizes:
        fits = [(room, -last, k) for k, (room, _, last) in enumerate(bins) if room >= size]
        if fits:
            k = min(fits)[2]
        else:
            c = min((c for c in lengths if c >= size), key=lambda c: (K.cost(c) / min(c, rest), c))
            k = len(bins)
            bins.append([c, 0, 0])
        out.append((k, bins[k][1]))
        bins[k][0] -= size
        bins[k][1] += size
        bins[k][2] = len(out)
        rest -= size
    final = [min(c for c in lengths if c >= n) for _, n, _ in bins]
    return [(k, final[k], o) for k, o in out]


def test_equals_plain_search():
    rnd = random.Random(9)
    for _ in range(200):
        lengths = tuple(sorted(rnd.sample([8, 16, 24, 32, 64, 100], 3)))
        sizes = sorted((rnd.randrange(1, max(lengths) + 1) for _ in range(rnd.randrange(1, 60))), reverse=True)
        assert K.pack(sizes, lengths) == plain(sizes, lengths)


def test_cheaper_than_one_length():
    rnd = random.Random(8)
    sizes = sorted((min(4096, int(rnd.paretovariate(1) * 60)) for _ in range(5000)), reverse=True)
    total = lambda lengths: sum(K.cost(c) for _, c in {(k, c) for k, c, _ in K.pack(sizes, lengths)})
    assert total(K.LENGTHS) < total((4096,)) and K.pack([], K.LENGTHS) == []


def check(rows, words, lengths):
    bins, by_doc = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append((r.start, r.size))
    for own in bins.values():
        spans = sorted((r.offset, r.offset + r.size) for r in own)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert {r.bin_length for r in own} == {min(c for c in lengths if c >= spans[-1][1])}
    assert {k: sum(n for _, n in v) for k, v in by_doc.items()} == {k: n for k, n in words.items() if n}
    for v in by_doc.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:]))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    rows = K.best_fit(docs, shard_pieces=40).collect()
    check(rows, words, K.LENGTHS)
    assert len({r.sequence_id.split("-")[0] for r in rows}) > 2
    assert sum(r.size for r in rows) / sum({r.sequence_id: r.bin_length for r in rows}.values()) > 0.6


def test_sequences_in_tokens(spark):
    import public_tokenizers

    from strandloom.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    tokens = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).cache()
    ids = {r.doc_id: r.ids for r in tokens.collect()}
    packed = K.best_fit(tokens, size_col="n_tokens", text_col=None).cache()
    check(packed.collect(), {k: len(v) for k, v in ids.items()}, K.LENGTHS)
    rebuilt = {}
    for r in K.sequences(packed).collect():
        assert [p.offset for p in r.pieces] == [sum(q.size for q in r.pieces[:k]) for k in range(len(r.pieces))]
        assert r.used == sum(p.size for p in r.pieces) <= r.bin_length
        for p in r.pieces:
            rebuilt.setdefault(p.doc_id, {})[p.start] = ids[p.doc_id][p.start : p.start + p.size]
    assert {k: sum((v[s] for s in sorted(v)), []) for k, v in rebuilt.items()} == {k: v for k, v in ids.items() if v}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "a b", 7), (None, "a b", 7), (3, "w " * 10_000, 1)], "doc_id bigint, text string, shard int")
    rows = K.best_fit(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.size) for r in rows) == [(0, 0, 2), (0, 0, 2), (3, 0, 4096), (3, 1, 4096), (3, 2, 1808)]
    assert K.best_fit(df.limit(0)).count() == 0
