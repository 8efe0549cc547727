"""Byte-level BPE in linear time: longest matches with backtracking over adjacent-token compatibility.

Tokens are mapped byte by byte to Latin-1 so that one Aho-Corasick automaton finds every token in a piece. A piece is
covered from the left with the longest token at each place; a token may follow another only if merging by rank would
leave exactly this pair side by side. If no token fits, the place is marked dead and the last token is shortened. Each
place dies at most once, so the work is linear in the piece, and the result is what the merges give.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.chunks import ChunkEncoder, one_by_one
from tidegauge.llm.common import WIDE_SLICE_BYTES, table, text_slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Remembered pairs of adjacent tokens, and the longest chunk kept in the memo of pieces.
MAX_PAIRS = 400_000
MAX_PIECES = 400_000
MAX_CHUNKS = 400_000
MAX_PIECE_CHARS = 64


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [found[i] for i in range(len(found))]


class BytePairEncoder:
    """Encoder over token bytes in rank order; every single byte must be a token."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        for i, token in enumerate(tokens):
            self._split(i, token)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((i for n in range(len(token) - 1, 0, -1) if (i := self.ids.get(token[:n])) is not None), -1)

    def _split(self, i: int, token: bytes) -> None:
        """The last merge that makes a token: of two earlier tokens that stay apart until then."""
        if len(token) == 1:
            return
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(token[self.lengths[left] :])
            if right is not None and left < i and right < i and self._apart(left, right):
                self.halves[i] = (left, right)
                self.merged[left, right] = i
                return
            left = self.shorter[left]

    def _apart(self, left: int, right: int) -> bool:
        """Would merging by rank leave left and right as they are? Undo merges on both sides of the border, the
        latest first; if a pair across the border was mergeable before what has been undone, it would have merged."""
        bound = len(self.tokens)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            l_half, r_half = self.halves[left], self.halves[right]
            if l_half is None and r_half is None:
                return True
            if r_half is None or (l_half is not None and left > right):
                bound, left = left, l_half[1]
            else:
                bound, right = right + 1, r_half[0]

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > MAX_PAIRS:
                self.fits.clear()
            found = self.fits[left, right] = self._apart(left, right)
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, shorter = len(piece), self.lengths, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends only grow: the last one is the longest
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (alive[at + lengths[token]] and (not out or self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(load_ranks(path))


@functools.lru_cache(maxsize=2)
def piece_memo(path: str, pattern: str) -> ChunkEncoder:
    """Memo over chunks; a new chunk is cut by the pattern and each match encoded for itself."""
    bpe, pieces = encoder(path), regex.compile(pattern)
    known: dict[str, tuple[int, ...]] = {}

    def one(piece: str) -> tuple[int, ...]:
        ids = known.get(piece)
        if ids is None:
            ids = tuple(bpe.encode(piece.encode()))
            if len(piece) <= MAX_PIECE_CHARS:
                if len(known) > MAX_PIECES:
                    known.clear()
                known[piece] = ids
        return ids

    def encode(chunk: str) -> list[int]:
        return [i for piece in pieces.findall(chunk) for i in one(piece)]

    return ChunkEncoder(one_by_one(encode, MAX_CHUNKS), keeps_space=True)


def encode_decode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; decoded holds the bytes of the ids. A null text counts as empty."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bpe = piece_memo(ranks, pattern), encoder(ranks)
        for doc_id, parts in _encoded(batches, memo):
            counts = [len(x) for x in parts]
            lists = pa.array([x.tolist() for x in parts], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, type=pa.int64()), lists, pa.array([bpe.decode(x.tolist()) for x in parts], type=pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return _inputs(docs).mapInArrow(step, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip without carrying its ids and bytes along."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bpe = piece_memo(ranks, pattern), encoder(ranks)
        decimal = [str(i) for i in range(len(bpe.tokens))]
        for doc_id, parts in _encoded(batches, memo):
            counts, of_ids, of_bytes = [], [], []
            for part in parts:
                ids = part.tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, type=pa.int64()), pa.array(of_ids, type=pa.string()), pa.array(of_bytes, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _inputs(docs).mapInArrow(step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], memo: ChunkEncoder) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for whole in batches:
        for batch in text_slices(whole, "text", WIDE_SLICE_BYTES):
            ids, ends = memo.encode_batch(batch.column("text"))
            yield batch.column("doc_id"), [ids[a:b] for a, b in pairwise([0, *ends.tolist()])]


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return digests(table(spark, sf_dir, "documents"))
