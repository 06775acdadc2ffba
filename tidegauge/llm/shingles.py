"""Hashes of word shingles, worked out for many texts at once.

Words are split at the white space of ASCII; A-Z count as lower case. A word's hash is a polynomial in its bytes, taken
from running sums over a whole run of texts, so that no word is touched one by one; a shingle's hash mixes those of its
words. Fewer words than a shingle: the whole sequence is one shingle. Null texts count as empty, and these have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed at a time; a single longer text is a run of its own, hashed in steps of this size.
STEP = 500_000
#: A fixed odd multiplier of a word's bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C17
BACK = pow(BASE, -1, 2**64)
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of a shingle's words; they have no small relation, so that no two orders of words are alike.
OF_WORD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, each to the power of 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BACK)):
            _powers[k] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, STEP) - 1, b, np.uint64)])
    return _powers[0], _powers[1]


def word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word low[begin:end]; words come in order."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + STEP, "right")))
        first, size = begin[at], end[upto - 1] - begin[at]
        up, back = powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((low[first : first + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        b, e = begin[at:upto] - first, end[at:upto] - first
        out[at:upto] = (sums[e] - sums[b]) * back[b]
        at = upto
    return mix(out)


def words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes, edges) of runs of texts: text `first + i` has the word hashes edges[i] to edges[i + 1]."""
    whole = texts.cast(pa.large_string()).fill_null("")
    if not len(whole):
        return
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data, first = whole.buffers()[2], 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        low = np.frombuffer(data.slice(lo, hi - lo).to_pybytes().translate(_LOWER) if hi > lo else b"", np.uint8)
        black = ~_WHITE[low]
        starts = offsets[first : last + 1] - lo
        fresh = np.zeros(len(low) + 1, bool)  # where a text begins, a word ends
        fresh[starts] = True
        begin = np.flatnonzero(black & np.r_[True, ~black[:-1]][: len(low)] | black & fresh[:-1])
        end = np.flatnonzero(black & np.r_[~black[1:], True][: len(low)] | black & fresh[1:]) + 1
        yield first, word_hashes(low, begin, end), np.searchsorted(begin, starts)
        first = last


def runs(hashes: np.ndarray, edges: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles of `size` words, in their order, repeats included."""
    h = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        h += hashes[k : k + len(h)] * OF_WORD[k]
    h = mix(h)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            yield h[a : b - size + 1]
        elif b > a:
            yield mix((hashes[a:b] * OF_WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def distinct(run: np.ndarray) -> np.ndarray:
    """The set of a text's shingles, in order of their hashes."""
    x = np.sort(run)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def name_of(held: np.ndarray) -> int:
    """A 64-bit name of a set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).astype(np.int64))


def majority(run: np.ndarray) -> int:
    """A fingerprint: each bit is 1 if it is in over half of the hashes; zero for none. Signed."""
    sums = np.zeros(64, np.int64)
    for s in range(0, len(run), 65536):
        sums += np.unpackbits(run[s : s + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(run), bitorder="little").view("<i8")[0])
