"""Batch tokenisation by chunks.

A chunk is what stands between two spaces. A space that a non-space follows always begins a new piece of the
pre-tokeniser, so a text's ids are its chunks' ids one after the other. A batch's chunks are dictionary-encoded, each
distinct one is encoded once, and one NumPy gather lays the ids out. What words and marks become is remembered from
batch to batch; the memo is emptied when it holds too much, so memory stays bounded on any corpus. A text over
LONG_BYTES goes through in parts that begin with such a space.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidegauge.llm.common import gather

MAX_UNITS = 400_000
#: Texts of more bytes are encoded in parts of about as many characters.
LONG_BYTES = 8 << 20

#: White space of Unicode, and what Python counts as such beside it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BEFORE_WORD = re.compile(r"(?= \S)")
_TAIL = ".,;:!?*&$#%|"
_LETTERS = "".join(chr(c) for c in range(0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
_PLAIN = f"^\n?[{_LETTERS}]{{1,63}}[{re.escape(_TAIL)}]{{0,16}}$"

#: Ids of many chunks in a row, and how many each chunk has.
Encoded = tuple[np.ndarray, np.ndarray]


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable Latin-1, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def parts_of(text: str, size: int) -> Iterator[str]:
    """Consecutive parts of about size characters; all but the first begin with a space that a non-space follows."""
    start = 0
    while len(text) - start > size and (m := _BEFORE_WORD.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class ChunkEncoder:
    """Ids of whole texts. encode(chunks, before) gives the ids of distinct chunks, with the space that may stand before
    each; keeps_space: a chunk inside a text stands for ' ' + chunk, unless a line break begins it. special: strings that
    are one id each wherever they stand; what stands between them is encoded for itself."""

    def __init__(self, encode: Callable[[pa.Array, pa.Array], Encoded], keeps_space: bool, special: dict[str, int] | None = None) -> None:
        self.encode, self.keeps_space, self.special = encode, keeps_space, special or {}
        self.apart = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None

    def _encode_columns(self, *columns: tuple[pa.Array, str]) -> tuple[Encoded, list[np.ndarray]]:
        """Encode the distinct chunks of columns, each with its lead, in one call; slots of each column in what comes out."""
        coded = [(chunks.dictionary_encode(), lead) for chunks, lead in columns]
        distinct = pa.concat_arrays([c.dictionary for c, _ in coded])
        leads = pa.concat_arrays([pa.repeat(pa.scalar(lead, type=pa.large_string()), len(c.dictionary)) for c, lead in coded])
        encoded = self.encode(distinct, pc.if_else(pc.starts_with(distinct, "\n"), pa.scalar("", type=pa.large_string()), leads))
        firsts = np.cumsum([0, *[len(c.dictionary) for c, _ in coded]]).tolist()
        return encoded, [c.indices.to_numpy().astype(np.int64) + first for (c, _), first in zip(coded, firsts, strict=False)]

    @staticmethod
    def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks of texts with white space side by side, cut only where a space meets a non-space; which of them stand
        inside (without their space then); how many each text has."""
        cuts = [_BEFORE_WORD.split(t) for t in texts]
        chunks = [x for cut in cuts for x in cut]
        inside = np.array([x[:1] == " " and x[1:2] not in ("", "\n") for x in chunks], dtype=bool)
        return [x[1:] if i else x for x, i in zip(chunks, inside.tolist(), strict=True)], inside, np.array([len(c) for c in cuts], dtype=np.int64)

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's end in them; end_id follows each text. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        apart = pc.greater(pc.binary_length(texts), LONG_BYTES).to_numpy(zero_copy_only=False)
        for s in self.special:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._encode_plain(texts, end_id)
        own = {i: self._encode_apart(texts[i].as_py(), end_id) for i in np.flatnonzero(apart).tolist()}
        ids, ends = self._encode_plain(pc.if_else(pa.array(apart), "", texts), end_id)
        found = [own[i] if apart[i] else ids[ends[i - 1] if i else 0 : ends[i]] for i in range(n)]
        return np.concatenate(found), np.cumsum([len(x) for x in found])

    def _encode_apart(self, text: str, end_id: int | None) -> np.ndarray:
        """Ids of one text that holds special strings or is long."""
        out = [np.empty(0, dtype=np.uint32)]
        for piece in self.apart.split(text) if self.apart else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], dtype=np.uint32))
            elif piece:
                out += [self._encode_plain(pa.array([x], type=pa.large_string()), None)[0] for x in parts_of(piece, LONG_BYTES // 2)]
        if end_id is not None:
            out.append(np.array([end_id], dtype=np.uint32))
        return np.concatenate(out)

    def _encode_plain(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        n, lead = len(texts), " " if self.keeps_space else ""
        odd = np.zeros(n, dtype=bool)
        if self.keeps_space:
            odd = pc.match_substring_regex(texts, f"{_SPACE}{{2}}").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n" if self.keeps_space else " "), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        counts = np.diff(bounds)
        first = chunks.take(pa.array(bounds[:-1] if self.keeps_space else bounds[:0]))
        cut, inside, sizes = self._cut(texts.filter(pa.array(odd)).to_pylist())
        cut = pa.array(cut, type=pa.large_string())
        (flat, lengths), (slots, first, cut_in, cut_first) = self._encode_columns((chunks, lead), (first, ""), (cut.filter(pa.array(inside)), lead), (cut.filter(pa.array(~inside)), ""))
        if self.keeps_space:
            slots[bounds[:-1]] = first
        if odd.any():
            own = np.empty(len(inside), dtype=np.int64)
            own[inside], own[~inside] = cut_in, cut_first
            parts = iter(np.split(own, np.cumsum(sizes)[:-1]))
            counts[odd] = sizes
            slots = np.concatenate([next(parts) if odd[i] else slots[bounds[i] : bounds[i + 1]] for i in range(n)])
        if end_id is not None:
            slots = np.insert(slots, np.cumsum(counts), len(lengths))
            counts = counts + 1
            flat, lengths = np.append(flat, np.uint32(end_id)), np.append(lengths, 1)
        starts = (np.cumsum(lengths) - lengths)[slots]
        lengths = lengths[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return gather(flat, starts, lengths), ends


class _Memo:
    """Ids of strings by number; number 0 is the empty one. New strings are encoded once and entered."""

    def __init__(self, encode: Callable[[str], Sequence[int]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([""], type=pa.large_string())
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = self.lengths = np.zeros(1, dtype=np.int64)

    def numbers(self, strings: pa.Array) -> np.ndarray:
        coded = strings.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        if not at.null_count:
            return at.to_numpy()[coded.indices.to_numpy()]
        before, missing = len(self.keys), pc.is_null(at)
        new = coded.dictionary.filter(missing)
        self.keys = pa.concat_arrays([self.keys, new])
        # Ids go into one array as they come: a list for each string would be walked by the garbage collector again and again.
        found, lengths = array("I"), np.empty(len(new), dtype=np.int64)
        for i, string in enumerate(new.to_numpy(zero_copy_only=False)):
            ids = self.encode(string)
            lengths[i] = len(ids)
            found.extend(ids)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.array(found, dtype=np.uint32)])
        numbers = pc.fill_null(at, 0).to_numpy().copy()
        numbers[missing.to_numpy(zero_copy_only=False)] = np.arange(before, before + len(new))
        return numbers[coded.indices.to_numpy()]


def one_by_one(encode: Callable[[str], Sequence[int]], keep: int) -> Callable[[pa.Array, pa.Array], Encoded]:
    """encode() for many chunks, with a memo of at most about keep of them."""
    memo = _Memo(encode)

    def many(chunks: pa.Array, before: pa.Array) -> Encoded:
        if len(memo.keys) > keep:
            memo.clear()
        at = memo.numbers(pc.binary_join_element_wise(before, chunks, pa.scalar("", type=pa.large_string())))
        return gather(memo.flat, memo.starts[at], memo.lengths[at]), memo.lengths[at]

    return many


class _Units:
    """Ids of chunks through the library. A plain Latin word with a run of marks after it is two units, which go to the
    library's model without the pre-tokeniser, since that would cut there alone; any other chunk is one unit and takes
    the library's whole way. Words and marks have memos of their own, so that the small one is quick."""

    def __init__(self, tokenizer, keeps_space: bool) -> None:  # noqa: ANN001  tokenizers.Tokenizer
        letters = byte_letters()
        self.tokenizer, self.model, self.keeps_space = tokenizer, tokenizer.model, keeps_space
        self.to_letters = {chr(b): letters[b] for b in range(256)}
        self.words, self.marks = _Memo(self._ids), _Memo(self._ids)

    def _ids(self, unit: str) -> Sequence[int]:
        if unit[0] == "\0":
            return self.tokenizer.encode(unit[1:], add_special_tokens=False).ids
        if unit.isascii() and unit != "\n":
            mapped = unit.replace(" ", self.to_letters[" "])
        else:
            mapped = "".join(map(self.to_letters.__getitem__, unit.encode().decode("latin-1")))
        return [t.id for t in self.model.tokenize(mapped)]

    def __call__(self, chunks: pa.Array, before: pa.Array) -> Encoded:
        for memo in (self.words, self.marks):
            if len(memo.keys) > MAX_UNITS:
                memo.clear()
        none = pa.scalar("", type=pa.large_string())
        plain = pc.match_substring_regex(chunks, _PLAIN)
        bodies = pc.utf8_ltrim(chunks, characters="\n")
        words, tails = pc.utf8_rtrim(bodies, characters=_TAIL), pc.utf8_ltrim(bodies, characters=_LETTERS)
        words = pc.binary_join_element_wise(before, words, none) if self.keeps_space else pc.utf8_lower(words)
        whole = pc.binary_join_element_wise(before, chunks, none)
        whole = pc.if_else(pc.equal(whole, ""), none, pc.binary_join_element_wise(pa.scalar("\0", type=pa.large_string()), whole, none))
        word, tail = self.words.numbers(pc.if_else(plain, words, whole)), self.marks.numbers(pc.if_else(plain, tails, none))
        columns = [(self.words, word), (self.marks, tail)]
        if self.keeps_space:
            broken = pc.and_(plain, pc.starts_with(chunks, "\n"))
            columns.insert(0, (self.marks, self.marks.numbers(pc.if_else(broken, pa.scalar("\n", type=pa.large_string()), none))))
        shift = len(self.words.flat)
        lengths = np.stack([m.lengths[k] for m, k in columns], axis=1)
        starts = np.stack([m.starts[k] + (shift if m is self.marks else 0) for m, k in columns], axis=1)
        return gather(np.concatenate([self.words.flat, self.marks.flat]), starts.ravel(), lengths.ravel()), lengths.sum(axis=1)


@functools.lru_cache(maxsize=4)
def library_encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder a Python worker and file. keeps_space: a byte-level vocabulary (spaces are part of the ids) or one that
    drops white space and case. Special strings within a text become their ids, as is the library's default."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return ChunkEncoder(_Units(tokenizer, keeps_space), keeps_space, special)
