"""Operator 12: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. An n-gram's vector binds those of its letters,
each rotated by its place, by multiplication; a text's vector bundles (adds) those of all its n-grams, and a language's
prototype those of all n-grams of its training texts. The language whose prototype has the largest cosine with a text's
vector is predicted. N-grams are of three letters, in lower case, where each run of other characters counts as one
separator and a text begins and ends with one.

Vectors are made of whole numbers, so prototypes do not depend on the order in which tasks are added up. A task counts
n-grams of many texts at once and multiplies the counts with the n-grams' vectors; a training task sends one sum for each
language, which are added in two steps, so that no group grows with the number of tasks alone. Prototypes are broadcast in
slices of a fixed number of languages; each further slice is one more pass over the texts.

Defined results: a null text and one without a letter are `und` with score 0, as is every text when nothing was learned;
the score is the cosine, 0 if that is negative; ties go to the first language in bytewise order; a row without an id is in
training (its id is an empty text); every row gives a row, repeated ones too; an empty table gives no rows; columns other
than id, text and language are ignored, and the language is read of training rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BATCH_ROWS, arrow_schema, table, written
from .jaccard import mixed

#: Components of a vector, and the letters of an n-gram.
DIMENSIONS, GRAM = 1024, 3
#: Characters whose n-grams are counted at once, n-grams whose vectors are held at once, and n-grams that a table can number.
PIECE, SLICE, NUMBERED = 200_000, 8192, 1 << 22
#: Languages of a broadcast, of a task's sums before they are sent, and tasks that are added in the first step, by their number.
LANGUAGES, HELD, SALTS = 4096, 512, 256

_MUL, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code point; 0 stands for the separator."""
    with np.errstate(over="ignore"):
        bits = mixed(mixed(codes.astype(np.uint64)[:, None] * _MUL + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * _STEP))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(is_letter()[codes], codes, 0).astype(np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, symbol) arrays of about PIECE characters, separators collapsed; a longer text goes on in the next
    piece, which repeats the last symbols, so that each n-gram is in one piece."""
    held, size = [], 0
    for k, text in enumerate(texts):
        text, carry = text or "", np.zeros(1, np.uint32)
        for start in range(0, max(1, len(text)), PIECE):
            part = np.concatenate([carry, symbols(text[start : start + PIECE]), np.zeros(int(start + PIECE >= len(text)), np.uint32)])
            part = part[np.r_[True, (part[1:] != 0) | (part[:-1] != 0)]]
            carry = part[1 - GRAM :]
            held.append((np.full(len(part), k), part))
            size += len(part)
            if size >= PIECE or start + PIECE < len(text):
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def counted(owner: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have n-grams, the letters of each distinct n-gram, and counts by text and n-gram."""
    within = owner[GRAM - 1 :] == owner[: 1 - GRAM]
    alphabet, at = np.unique(symbol, return_inverse=True)
    code = np.zeros(max(0, len(symbol) - GRAM + 1), np.int64)
    for k in range(GRAM):
        code = code * len(alphabet) + at[k : k + len(code)]
    code, owner = code[within], owner[: len(code)][within]
    if len(alphabet) ** GRAM <= NUMBERED:
        present = np.zeros(len(alphabet) ** GRAM, bool)
        present[code] = True
        grams, number = np.flatnonzero(present), (np.cumsum(present) - 1)[code]
    else:
        grams, number = np.unique(code, return_inverse=True)
    texts, row = np.unique(owner, return_inverse=True)
    counts = np.bincount(row * len(grams) + number, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams))
    letters = np.stack([alphabet[grams // len(alphabet) ** (GRAM - 1 - k) % len(alphabet)] for k in range(GRAM)]) if len(grams) else np.zeros((GRAM, 0), np.uint32)
    return texts, letters, counts


def gram_vectors(letters: np.ndarray) -> np.ndarray:
    """Vectors of n-grams: letters rotated by their place, bound."""
    alphabet, at = np.unique(letters, return_inverse=True)
    vectors, at = letter_vectors(alphabet), at.reshape(letters.shape)
    out = vectors[at[-1]]
    for k in range(GRAM - 1):
        out *= np.roll(vectors, GRAM - 1 - k, axis=1)[at[k]]
    return out


def bundled(letters: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the n-grams' vectors by row of `counts`, exactly."""
    out = np.zeros((len(counts), DIMENSIONS), np.int64)
    for start in range(0, counts.shape[1], SLICE):
        part = counts[:, start : start + SLICE].astype(np.float32 if counts.sum() < 1 << 24 else np.float64)
        out += (part @ gram_vectors(letters[:, start : start + SLICE]).astype(part.dtype)).astype(np.int64)
    return out


def vectors_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, vector) of each text that has a letter, in order."""
    last, total = None, None
    for owner, symbol in pieces(texts):
        found, letters, counts = counted(owner, symbol)
        for k, vector in zip(found.tolist(), bundled(letters, counts)):
            if k == last:
                total = total + vector
            else:
                if last is not None:
                    yield last, total
                last, total = k, vector
    if last is not None:
        yield last, total


SUMS = "lang string, salt bigint, vector binary"


def prototypes(train: DataFrame) -> DataFrame:
    """(lang, vector): the bundle of all training texts (text, lang) of a language, as packed 64-bit integers."""
    target = arrow_schema(StructType.fromDDL(SUMS))

    def learn(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            salts = [salt] * len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(salts, pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=target)
            sums.clear()

        for batch in batches:
            salt = batch.column(2)[0].as_py() if batch.num_rows else 0
            for start in range(0, batch.num_rows, BATCH_ROWS):
                texts, langs, _ = (c.to_pylist() for c in batch.slice(start, BATCH_ROWS).columns)
                for owner, symbol in pieces(texts):
                    found, letters, counts = counted(owner, symbol)
                    names, at = np.unique(np.array([langs[k] for k in found], object), return_inverse=True) if len(found) else ([], [])
                    by_lang = np.zeros((len(names), counts.shape[1]), np.int64)
                    np.add.at(by_lang, at, counts)
                    for name, vector in zip(names, bundled(letters, by_lang)):
                        sums[name] = sums[name] + vector if name in sums else vector
                    if len(sums) >= HELD:
                        yield from flush()
        if sums:
            yield from flush()

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in group.column("vector").to_pylist())
        return pa.Table.from_arrays([group.column("lang").slice(0, 1), group.column("salt").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lang", "salt", "vector"])

    sent = train.select("text", "lang", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("bigint")).mapInArrow(learn, SUMS)
    salted = sent.groupBy("lang", "salt").applyInArrow(added, SUMS)
    return salted.groupBy("lang").applyInArrow(added, SUMS).select("lang", "vector")


PREDICTED = "doc_id bigint, held_out boolean, text string, lang_pred string, score double"


def predict(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, given the prototypes."""
    spark, target = docs.sparkSession, arrow_schema(StructType.fromDDL(PREDICTED))
    none = F.lit(None)
    rows = docs.select("doc_id", "held_out", "text", none.cast("string").alias("lang_pred"), none.cast("double").alias("score"))
    last = None
    while True:
        left = profiles if last is None else profiles.where(F.col("lang") > last)
        found = left.orderBy("lang").limit(LANGUAGES).collect()
        if not found:
            break
        last = found[-1]["lang"]
        matrix = np.stack([np.frombuffer(r["vector"], np.int64) for r in found]).astype(float)
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([r["lang"] for r in found], np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)))

        def compare(batches, shared=shared):
            names, matrix = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    langs, scores = part.column(3).to_pylist(), part.column(4).to_pylist()
                    for k, vector in vectors_of(part.column(2).to_pylist()):
                        length = np.sqrt(float(vector @ vector))
                        cosines = matrix @ (vector / length) if length else np.zeros(len(names))
                        best = int(cosines.argmax())
                        if langs[k] is None or cosines[best] > scores[k]:
                            langs[k], scores[k] = names[best], float(cosines[best])
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=target)

        rows = rows.mapInArrow(compare, PREDICTED)
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("score"))


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and have a language; predict every row's."""
    held_out = F.coalesce(held_out, F.lit(False))
    train = docs.where(~held_out & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    profiles = written(prototypes(train))
    return predict(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")), profiles)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return identify(table(spark, sf_dir, "documents"), held_out)
