"""Whole-text encoding with each distinct chunk encoded once.

A text is cut where no pre-token of the pre-tokenizers used here can cross and
no normalizer looks across; the ids of the text are the ids of its chunks in
order. The cuts are found on the bytes of a whole batch with numpy, Arrow
numbers the distinct chunks, a bounded memo in the Python worker answers most
of them, and numpy lays out the ids.

Characters count as letters (ASCII, and those up to U+024F), digits and signs
(ASCII), the apostrophe, space, newline, other characters that are surely not
white space, and the rest. Cuts lie before a space or newline that follows a
non-space, around a newline that precedes a non-space, and between letters,
digits and signs. An apostrophe may start a contraction and a combining mark
joins what precedes it, so nothing else is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks and ids in each of the memo's two generations, and the longest chunk kept there (bytes).
GENERATION = 200_000
GENERATION_IDS = 2_000_000
MEMO_BYTES = 64

LETTER, DIGIT, SIGN, APOSTROPHE, OTHER, SPACE, NEWLINE, UNSURE = range(8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[:0x21] = _CLASS[0x7F] = UNSURE
_CLASS[0x21:0x7F] = SIGN
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[ord("'")], _CLASS[ord(" ")], _CLASS[ord("\n")] = APOSTROPHE, SPACE, NEWLINE
#: Two-byte letters end at U+024F (C9 8F). Not letters: U+00D7, U+00F7; U+0130 becomes two characters in lower case.
_NO_LETTERS = (0xC397, 0xC3B7, 0xC4B0)


def classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 data belongs to."""
    out = _CLASS[data]
    if not len(data) or data.max() < 0x80:
        return out
    lead = np.flatnonzero(data >= 0xC2)
    second = data[np.minimum(lead + 1, len(data) - 1)].astype(np.int32)
    pair = (data[lead].astype(np.int32) << 8) | second
    letter = (pair >= 0xC380) & (pair <= 0xC98F) & ~np.isin(pair, _NO_LETTERS)
    out[lead[letter]] = out[lead[letter] + 1] = LETTER
    # White space beyond ASCII, and its neighbours, are in U+0080-00A0, U+1680, U+180E, U+2000-200B, U+2028-202F, U+205F, U+3000.
    blank = (pair >= 0xC280) & (pair <= 0xC2A0)
    out[lead[blank]] = out[lead[blank] + 1] = UNSURE
    some = np.isin(pair, (0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380))
    if some.any():
        lead, pair = lead[some], pair[some]
        third = data[np.minimum(lead + 2, len(data) - 1)]
        blank = ((pair == 0xE19A) | (pair == 0xE380)) & (third == 0x80) | (pair == 0xE1A0) & (third == 0x8E) | (pair == 0xE281) & (third == 0x9F)
        blank |= (pair == 0xE280) & ((third <= 0x8B) | (third >= 0xA8) & (third <= 0xAF))
        for k in range(3):
            out[lead[blank] + k] = UNSURE
    return out


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a cut lies before each byte; texts begin at starts."""
    kind = classes(data)
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        a, b = kind[:-1], kind[1:]
        solid = kind <= OTHER
        last = (a == NEWLINE) & solid[1:]
        last[starts[starts > 0] - 1] = False
        out[1:] = solid[:-1] & ((b == SPACE) | (b == NEWLINE)) | last | (a != b) & (a <= SIGN) & (b <= SIGN)
        out[:-1] |= last
    out[starts] = True
    return out


class Memo:
    """Ids of chunks: entry k of `index` begins at begin[k] in flat and has size[k] ids."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> int:
        """Appends entries and returns the number of the first; the caller names them in index."""
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        first, stop = self.n, self.n + len(sizes)
        self.begin[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.size[first:stop] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = stop, self.used + len(ids)
        return first

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the entries, and their ids one after another."""
        sizes = self.size[entries]
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        return sizes, self.flat[np.repeat(self.begin[entries] - (stop - sizes), sizes) + np.arange(total)]


class ChunkEncoder:
    """Encodes batches of texts by `learn`, which gives sizes and ids of chunks.

    Texts that hold one of the strings `whole` are not cut. An Arrow string
    chunk that learn never sees has been met before by this worker; what it
    gives for a chunk may depend on nothing but that chunk.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Sequence[str] = ()):
        self.learn, self.whole = learn, tuple(whole)
        self.young, self.old = Memo(), Memo()

    def _entries(self, chunks: list[str]) -> np.ndarray:
        """Entry in the young memo of each of the distinct chunks."""
        young, old = self.young, self.old
        entry = np.fromiter(map(young.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        lack = entry < 0
        if not lack.any():
            return entry
        wanted = list(compress(chunks, lack))
        before = np.fromiter(map(old.index.get, wanted, repeat(-1)), np.int64, len(wanted))
        known = before >= 0
        fresh = np.empty(len(wanted), np.int64)
        fresh[known] = young.add(*old.ids(before[known])) + np.arange(int(known.sum()))
        unseen = list(compress(wanted, ~known))
        fresh[~known] = young.add(*self.learn(unseen)) + np.arange(len(unseen))
        entry[lack] = fresh
        young.index.update((c, e) for c, e in zip(wanted, fresh.tolist()) if len(c) <= MEMO_BYTES)
        return entry

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch of texts, null as empty, each followed by end if given."""
        if len(self.young.index) > GENERATION or self.young.used > GENERATION_IDS:
            self.old, self.young = self.young, Memo()
        column = pc.fill_null(column.cast(pa.string()), "")
        rows = len(column)
        if not rows:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        buffers = column.buffers()
        edge = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[edge[0] : edge[-1]] if edge[-1] > edge[0] else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        starts = edge[:-1][edge[:-1] < len(data)]
        cut = cuts(data, starts)
        for text in self.whole:
            for i in np.flatnonzero(pc.match_substring(column, text).to_numpy(zero_copy_only=False)):
                cut[edge[i] + 1 : edge[i + 1]] = False
        at = np.flatnonzero(cut)
        first = np.searchsorted(at, edge)
        strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = strings.dictionary_encode()
        entry = self._entries(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if end is not None:
            entry = np.insert(entry, first[1:], self.young.add(np.ones(1, np.int64), np.array([end], np.uint32)))
            first = first + np.arange(rows + 1)
        sizes, ids = self.young.ids(entry)
        return np.concatenate([[0], np.cumsum(sizes)])[first], ids


Encoded = tuple[np.ndarray, np.ndarray]


def interleaved(first: np.ndarray, a: Encoded, b: Encoded) -> Encoded:
    """Sizes and ids of entries that come in order from a where `first` holds, else from b."""
    sizes, begin = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    for mask, (own, _), base in ((first, a, 0), (~first, b, len(a[1]))):
        sizes[mask] = own
        begin[mask] = base + np.cumsum(own) - own
    stop = np.cumsum(sizes)
    total = int(stop[-1]) if len(stop) else 0
    return sizes, np.concatenate([a[1], b[1]])[np.repeat(begin - (stop - sizes), sizes) + np.arange(total)]


def flat(lists: Sequence[Sequence[int]]) -> Encoded:
    """Sizes of lists of ids, and all ids."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))


def id_lists(offsets: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
