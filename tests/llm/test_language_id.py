import zlib
from collections import Counter

import numpy as np
import pytest
from strandloom.llm import language_id as L

from ..helpers import SF

DDL = "doc_id bigint, text string, lang string, source string"


def plain_grams(text):
    symbols, last = [0], 0
    for c in (text or "").lower():
        c = ord(c) if c.isalpha() else 0
        if c or last:
            symbols.append(c)
        last = c
    if last:
        symbols.append(0)
    return Counter(zip(symbols, symbols[1:], symbols[2:]))


def plain_vector(text, memo):
    total = np.zeros(L.DIMENSIONS, np.int64)
    for gram, n in plain_grams(text).items():
        for c in gram:
            if c not in memo:
                memo[c] = L.letter_vectors(np.array([c]))[0].astype(np.int64)
        a, b, c = (memo[x] for x in gram)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def brute(rows):
    memo, sums = {}, {}
    vectors = [plain_vector(r[1], memo) for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 for r in rows]
    for r, v, away in zip(rows, vectors, held):
        if not away and r[2] is not None and plain_grams(r[1]):
            sums[r[2]] = sums.get(r[2], 0) + v
    names, out = sorted(sums, key=str.encode), []
    for r, v, away in zip(rows, vectors, held):
        if not plain_grams(r[1]) or not names:
            out.append((r[0], away, "und", 0.0))
            continue
        cosines = [float(sums[x] @ v) / (np.linalg.norm(sums[x].astype(float)) * np.linalg.norm(v.astype(float)) or 1) for x in names]
        best = int(np.argmax(np.round(cosines, 12)))
        out.append((r[0], away, names[best], min(1.0, max(0.0, cosines[best]))))
    return out


def same(df, rows):
    key = lambda r: (str(r[0]), str(r[2]), r[3])
    found, want = sorted(map(tuple, df.select("doc_id", "held_out", "lang_pred", "score").collect()), key=key), sorted(brute(rows), key=key)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want], abs=1e-9)
    return found


def query(spark, rows, tmp_path, ddl=DDL):
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    return L.op12_language_id(spark, str(tmp_path))


def test_equals_brute_force_and_is_right_on_held_out_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    found = same(L.op12_language_id(spark, SF), rows)
    truth = {r[0]: r[2] for r in rows}
    away = [r for r in found if r[1] and r[2] != "und"]
    assert len(away) > 20 and sum(truth[r[0]] == r[2] for r in away) >= 0.97 * len(away)


def test_labels_and_sources_of_predicted_rows_are_not_inputs(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    hidden = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else lang, None) for d, t, lang, _ in rows]
    a, b = (sorted(map(tuple, df.collect())) for df in (L.op12_language_id(spark, SF), query(spark, hidden, tmp_path)))
    assert a == b


def test_edge_rows(spark, tmp_path):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 34 !!", "de", None), (4, "the cat", "en", "a"), (4, "the cat", "en", "a"), (None, "die katze", "de", "b"), (5, "die " * 150_000, None, "b"), (6, "x", "", "b"), (7, "猫が好き", "ja", "c"), (8, "ÀÉ", None, "c")]
    same(query(spark, [(*r, "z") for r in rows], tmp_path, DDL + ", score string"), rows)


def test_nothing_learned_and_empty(spark, tmp_path):
    rows = [(1, "abc", None, None), (2, None, None, None)]
    same(query(spark, rows, tmp_path / "a"), rows)
    assert query(spark, [], tmp_path / "b").count() == 0


def test_pieces_slices_and_passes(spark, tmp_path, monkeypatch):
    """Texts over several pieces, n-grams over several slices, unnumbered n-grams, languages over several broadcasts."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source").collect()]
    for name, value in (("PIECE", 97), ("SLICE", 11), ("NUMBERED", 5)):
        monkeypatch.setattr(L, name, value)
    memo = {}
    for r in rows[:12]:
        got = list(L.vectors_of([None, r[1], "1"]))
        assert [k for k, _ in got] == [1] and (got[0][1] == plain_vector(r[1], memo)).all()
    monkeypatch.undo()
    monkeypatch.setattr(L, "LANGUAGES", 1)
    same(query(spark, rows, tmp_path), rows)
