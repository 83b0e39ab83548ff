"""Operator 6: byte-level BPE by longest matches and backtracking, and its decoding.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick trie of all tokens gives the longest token at any place
of a piece. Tokens are taken greedily; a token is accepted only if it is compatible with the one before it, that is, if
the merges of the two tokens' joint bytes would end in just these two. Compatibility of two adjacent tokens is memoised.
If no prefix fits, the last token is taken back and its end is marked as unreachable; every end is given up at most
once, so the work is linear in the piece. The result equals the merges by rank.

Defined results: a null text is as an empty one (no ids, the hash of no bytes); each row gives a row, repeated rows too;
any length of text is encoded whole; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Pieces remembered by a worker; beyond that many its memory of pieces starts anew.
MEMO = 400_000
#: Longest piece, in characters, that is remembered.
MEMO_CHARS = 64


class Vocabulary:
    """Ranks, and for every token that merges can make its two halves. Bounded by the vocabulary; broadcast once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for rank in sorted(ranks.values()):
            token = self.token[rank]
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if a < rank and b < rank and a in self.halves and b in self.halves and self.compatible(a, b):
                    self.halves[rank], self.pair[a, b] = (a, b), rank
                    break

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes leave the boundary between them.

        The halves that touch the boundary are undone from the latest merge on; a merge across the boundary happens if a
        pair that touches it makes a token of a lower rank than what comes next on either side.
        """
        below = len(self.token) + 1
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < below:
                return False
            if a > b:
                below, a = a, self.halves[a][1]
                if a == below:
                    below, b = b + 1, self.halves[b][0]
                    if b + 1 == below:
                        return True
            else:
                below, b = b + 1, self.halves[b][0]
                if b + 1 == below:
                    below, a = a, self.halves[a][1]
                    if a == below:
                        return True


#: Texts of these characters alone (ASCII and Latin letters) are split by the standard library, which is quicker there.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ɏ]*").fullmatch
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The classes of the pattern that the plain splitter stands in for, and what they are among plain characters.
PLAIN_CLASSES = ((r"[^\s\p{L}\p{N}]", rf"[^\s{LETTER}0-9]"), (r"\p{L}", f"[{LETTER}]"), (r"\p{N}", "[0-9]"))


class Encoder:
    """Encodes pieces of text; one for each worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.split_any = regex.compile(pattern).findall
        for name, chars in PLAIN_CLASSES:
            pattern = pattern.replace(name, chars)
        self.split_plain = self.split_any if r"\p" in pattern else re.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for rank in vocabulary.halves:
            self.trie.add_word(vocabulary.token[rank].decode("latin-1"), rank)
        self.known = {vocabulary.token[rank]: rank for rank in vocabulary.halves}
        self.window = max(map(len, self.known))
        self.less: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    def longest(self, raw: bytes, text: str, at: int) -> int | None:
        """The longest token at a place. A prefix in the trie need not be a token itself."""
        n = self.trie.longest_prefix(text[at : at + self.window])
        while n and raw[at : at + n] not in self.known:
            n -= 1
        return self.known[raw[at : at + n]] if n else None

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of the token."""
        if rank not in self.less:
            raw = self.v.token[rank][:-1]
            self.less[rank] = self.longest(raw, raw.decode("latin-1"), 0)
        return self.less[rank]

    def compatible(self, pair: tuple[int, int]) -> bool:
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            fits = self.fits[pair] = self.v.compatible(*pair)
        return fits

    def matches(self, raw: bytes) -> list[int]:
        """Ids of a piece: longest matches with backtracking."""
        text, token, whole = raw.decode("latin-1"), self.v.token, len(raw)
        open_end = bytearray(b"\1") * (whole + 1)
        out: list[int] = []
        at, rank = 0, self.longest(raw, text, 0)
        while True:
            end = at + len(token[rank])
            if open_end[end] and (not out or self.compatible((out[-1], rank))):
                out.append(rank)
                if end == whole:
                    return out
                at, rank = end, self.longest(raw, text, end)
            elif (less := self.shorter(rank)) is not None:
                rank = less
            else:
                open_end[at] = 0
                rank = out.pop()
                at -= len(token[rank])

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.v.ranks.get(raw)
        ids = self.matches(raw) if whole is None else [whole]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        text = text or ""
        get, piece = self.memo.get, self.piece
        return b"".join([get(x) or piece(x) for x in (self.split_plain if PLAIN(text) else self.split_any)(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_and_decode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document the number of ids, their SHA-256 and that of the decoded bytes; with_ids adds the ids themselves."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocab_path))
    encoders: list[Encoder] = []

    def rows(columns):
        if not encoders:
            encoders.append(Encoder(vocabulary.value, pattern))
        e = encoders[0]
        for doc_id, text in zip(*columns):
            ids = e.encode(text)
            out = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest())
            yield (*out, np.frombuffer(ids, dtype="<u4").tolist()) if with_ids else out

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), rows, schema + ", ids array<bigint>" * with_ids)


def token_counts(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; a null or empty text has none."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocab_path))
    encoders: list[Encoder] = []

    def rows(columns):
        if not encoders:
            encoders.append(Encoder(vocabulary.value, pattern))
        return ((doc_id, len(encoders[0].encode(text)) // 4) for doc_id, text in zip(*columns))

    return map_rows(docs.select(id_col, text_col), rows, "doc_id bigint, n_tokens bigint")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
