"""Word shingles of whole Arrow batches of texts, hashed with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text hashed at once.
SLICE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with all bits depending on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of each word, a run of bytes other than ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        inverse = pow(int(_BASE), -1, 1 << 64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), int(_BASE)))])
        # The powers of a word's place are divided out, so equal words hash equally.
        value = (total[stop] - total[first]) * _powers(len(data) + 1, inverse)[first]
        return first, mix(value + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batch_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash and count of each distinct shingle, ordered by doc; and a 128-bit key of each text's word sequence.

    Words are lower-cased. A text of one to four words is one shingle. Null
    texts and texts without a word have no shingle and key 0.
    """
    column = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    keys = np.zeros((n, 2), np.uint64)
    docs, hashes, counts = [], [], []
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        hi = min(hi, n)
        # A space between neighbours keeps their words apart.
        size = np.diff(offsets[lo : hi + 1])
        text = data[offsets[lo] : offsets[hi]]
        text = np.insert(text, (offsets[lo + 1 : hi] - offsets[lo]), 32)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        first, word = word_hashes(text)
        doc = np.searchsorted(begin, first, "right") - 1
        of_doc = np.bincount(doc, minlength=hi - lo)
        start = np.cumsum(of_doc) - of_doc
        if len(word):
            with np.errstate(over="ignore"):
                place = np.arange(len(word)) - start[doc]
                some = of_doc > 0
                for k, odd in enumerate((0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)):
                    whole = np.zeros(hi - lo, np.uint64)
                    whole[some] = np.add.reduceat(mix(word + place.astype(np.uint64) * np.uint64(odd)), start[some])
                    keys[lo:hi, k] = np.where(some, mix(whole + of_doc.astype(np.uint64)), 0)
                rolled = np.zeros(max(len(word) - WORDS + 1, 0), np.uint64)
                for k in range(WORDS):
                    rolled = mix(rolled + word[k : len(word) - WORDS + 1 + k]) if len(rolled) else rolled
            full = np.flatnonzero(doc[: len(rolled)] == doc[WORDS - 1 :]) if len(rolled) else np.zeros(0, np.int64)
            short = np.flatnonzero(some & (of_doc < WORDS))
            d = np.concatenate([doc[full], short])
            h = np.concatenate([rolled[full], keys[lo + short, 0]])
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
            at = np.flatnonzero(new)
            docs.append(d[at] + lo)
            hashes.append(h[at])
            counts.append(np.diff(np.append(at, len(d))))
        lo = hi
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(docs, np.int64), join(hashes, np.uint64), join(counts, np.int64), keys
