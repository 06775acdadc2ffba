"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte covered by a string of `LENGTH` bytes that also starts earlier (smaller id, or same id and earlier start) is
removed; strings are judged on the input. A text's suffixes (one for each start with LENGTH bytes after it) fall into
suffix buckets by the least hash among the SEED-byte strings they begin with up to byte LENGTH: equal strings share
their bucket, and neighbouring suffixes mostly do too, so that a bucket gets them as one run of bytes.

1. Texts are read in blocks. Runs that are equal within a block are combined there: all but the first are repeats. Only
   the first one's 128-bit digest goes to its bucket, so that a bucket gets each common run once from a block.
2. In its bucket, a run equal to an earlier one is a repeat as a whole. Buckets with several different runs ask for the
   bytes of each, as these may share strings only partly, and a run that repeats a string within itself asks for its
   own, even if it is alone; others are done.
3. Those buckets' suffixes are sorted one bucket at a time: by their first and last PERIOD bytes, and what ties there
   by the ranks of the next difference-cover positions, which were sorted before; two positions always have a cover
   position at the same distance less than PERIOD. Memory holds a block of buckets and the ranks of 6 in 31 positions.
   Buckets of more than `HOT` runs come as single strings, bucketed by their own digest and combined by block again.
4. Repeated starts are gathered by id, and the texts lose the bytes they cover.

Null texts are empty. Rows with a null id neither lose bytes nor count as earlier. Repeated rows of an id are judged
alike, and a string at the same id and start is not earlier than itself. Empty tables give no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, texts_in_pieces, written

LENGTH, SEED, PERIOD = 100, 24, 31
#: Cover positions modulo PERIOD: every difference occurs between two of them (a perfect difference set).
COVER = (1, 5, 11, 24, 25, 27)
HOT, BLOCK_BYTES, READ_CHARS = 20_000, 1_000_000, 1_000_000
#: Runs are cut after so many starts.
MOST_STARTS = LENGTH - SEED + 1

_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: By (residue of one position, residue of another): the distance to cover positions of both.
_TO_COVER = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _M1
    z += y * _M2
    z ^= z >> np.uint64(32)
    return z


def _hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the n bytes from every position on, for powers of two."""
    h = {1: _BYTES[data]}
    for n in (2, 4, 8, 16, 32, 64):
        p = h[n // 2]
        h[n] = _mix(p[: -(n // 2)], p[n // 2 :]) if len(p) > n // 2 else p[:0]
    return h


def _digest(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes at each of the positions."""
    return _mix(_mix(h[64][at], h[32][at + 64]), h[4][at + 96])


def _inner(h: dict[int, np.ndarray], seeds: np.ndarray, lows: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether two of a run's strings are equal. Equal strings of a run hold its least seed at two places of it, so only
    runs with it at two places have all their strings compared. lows: the least seed hash from every position on."""
    top, span = np.pad(lows, MOST_STARTS - 1), 1
    while span * 2 <= MOST_STARTS:
        top, span = np.maximum(top[:-span], top[span:]), span * 2
    top = np.maximum(top[: len(seeds)], top[MOST_STARTS - span : MOST_STARTS - span + len(seeds)])
    least = np.flatnonzero(seeds == top)  # where the seed is the least one of some string

    def members(first, n):
        return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)

    first, end = np.searchsorted(least, at), np.searchsorted(least, at + count + MOST_STARTS - 1)
    run, k = members(first, end - first)
    twice = np.flatnonzero(np.bincount(run[seeds[least[k]] == lows[at[run]]], minlength=len(at)) > 1)
    run, k = members(at[twice], count[twice])
    digest = _digest(h, k)
    order = np.lexsort((digest, run))
    same = (run[order][1:] == run[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    out = np.zeros(len(at), bool)
    out[twice[run[order][1:][same]]] = True
    return out


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, starts, bucket, digest, whether it repeats a string within itself) of the runs of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    begin = np.cumsum(sizes) - sizes
    h = _hashes(data)
    low = _mix(h[16][: len(data) - SEED + 1], h[8][16 : 16 + len(data) - SEED + 1])
    low ^= low >> np.uint64(29)
    low *= _M2
    n, span, seeds = len(data) - LENGTH + 1, 1, low
    while span * 2 <= MOST_STARTS:
        low_next = np.minimum(low[:-span], low[span:])
        low, span = low_next, span * 2
    low = np.minimum(low[:n], low[MOST_STARTS - span : MOST_STARTS - span + n])
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + LENGTH <= (begin + sizes)[owner]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    new |= (np.arange(n) - first) % MOST_STARTS == 0
    new &= inside
    at = np.flatnonzero(new)
    if not len(at):
        return runs([])
    ends = np.r_[at[1:], n]
    last = np.minimum(ends, (begin + sizes)[owner[at]] - LENGTH + 1) - 1
    count = last - at + 1
    digest = _mix(_mix(_digest(h, at), _digest(h, last)), count.astype(np.uint64))
    return owner[at], at - begin[owner[at]], count, low[at], digest, _inner(h, seeds, low, at, count)


def combined(ids: np.ndarray, start: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeat): rows sorted by key, id and start; whether a row has an earlier one with its key."""
    order = np.lexsort((start, ids, *key))
    same = np.ones(len(order), bool)
    for k in key:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    same[:1] = False
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    i, s = ids[order], start[order]
    return order, same & ((i != i[first]) | (s != s[first]))


def _words(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The bytes at each position as big-endian words; the last one overlaps the one before."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    return [np.ascontiguousarray(eight[at + o]).view(">u8").ravel().astype(np.uint64) for o in [*range(0, length - 8, 8), length - 8]]


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(strings: list[bytes], bucket: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(row, offset) of each string of LENGTH bytes in `strings` that an earlier one of its bucket equals."""
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings) + bytes(LENGTH + 8), np.uint8)
    row = np.repeat(np.arange(len(strings)), np.maximum(sizes - LENGTH + 1, 0))
    offset = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0))
    at = begin[row] + offset
    if not len(at):
        return np.zeros((0, 2), np.int64)
    # ranks of the cover positions by the bytes between a suffix's first and last PERIOD, from any distance to them
    middle = LENGTH - PERIOD
    sample = np.flatnonzero(_IN_COVER[np.arange(len(data) - LENGTH) % PERIOD])
    rank = np.full(len(data), -1, np.int64)
    rank[sample] = _ranks(_words(data, sample, middle))
    # suffix buckets, by the first and last bytes
    group = _ranks([bucket[row].astype(np.uint64), *_words(data, at, PERIOD), *_words(data, at + middle, PERIOD)])
    order = np.lexsort((start[row] + offset, ids[row], group))
    group, at, row, offset = group[order], at[order], row[order], offset[order]
    left, out, rounds = np.arange(len(at)), [], 0
    where = start[row] + offset
    while len(left):
        g = group[left]
        head = np.r_[True, g[1:] != g[:-1]]
        pivot = left[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))]  # the earliest of each bucket
        d = _TO_COVER[at[pivot] % PERIOD, at[left] % PERIOD]
        equal = rank[at[pivot] + d] == rank[at[left] + d]
        later = equal & ((ids[row[left]] != ids[row[pivot]]) | (where[left] != where[pivot]))
        out.append(left[later])
        left = left[~equal]
        rounds += 1
        if rounds == 32 and len(left):  # very many different strings with equal ends: the rest by all of their bytes
            sub = _ranks([group[left].astype(np.uint64), *_words(data, at[left], LENGTH)])
            o, again = combined(ids[row[left]], where[left], sub)
            out.append(left[o][again])
            break
    hit = np.concatenate(out)
    return np.stack([row[hit], offset[hit]], 1)


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c), pa.int64()) for c in columns], names.split())


def _whole_keys(batches):
    """Batches again, but each with all rows of its keys (the first column; rows come sorted by it)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        keys = b.column(0).to_numpy()
        if keys[0] == keys[-1] and held and held[-1].column(0)[len(held[-1]) - 1].as_py() == keys[0]:
            held.append(b)
            continue
        cut = int(np.argmax(keys != keys[0])) if keys[0] != keys[-1] else len(keys)
        if held and held[-1].column(0)[len(held[-1]) - 1].as_py() == keys[0]:
            held.append(b.slice(0, cut))
            b, keys = b.slice(cut), keys[cut:]
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(b):
            end = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if end:
                yield pa.Table.from_batches([b.slice(0, end)])
            held = [b.slice(end)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: INNER is a run that repeats a string within itself.
MARK, RUN, INNER = 0, 1, 2
_FOUND = "key long, digest long, doc_id long, start long, starts long, kind long"


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def _told(ids, start, starts, key, digest, inner):
    """Combined rows of one block: repeats as marks, the first of each key as a run."""
    order, again = combined(ids, start, digest, key)
    cols = [c[order] for c in (key, digest, ids, start, starts)]
    cols[0] = np.where(again, _mix(cols[2].view(np.uint64), cols[3].view(np.uint64)).view(np.int64), cols[0])
    return _batch([*cols, np.where(again, MARK, np.where(inner[order], INNER, RUN))], "key digest doc_id start starts kind")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, start, starts): the repeated strings' starts, as runs, of rows (doc_id long, text string)."""
    named = docs.where("doc_id is not null").select("doc_id", "text")

    def read(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in texts_in_pieces(b, "text", READ_CHARS):
                owner, start, starts, bucket, digest, inner = runs(_utf8(texts))
                yield _told(ids[first + owner], start, starts, bucket.view(np.int64), digest.view(np.int64), inner)

    def meet(batches):
        for t in _whole_keys(batches):
            key, digest, ids, start, starts, kind = (c.to_numpy() for c in t.columns)
            mark = kind == MARK
            yield _batch([ids[mark], start[mark], starts[mark], key[mark], np.full(mark.sum(), MARK)], "doc_id start starts key kind")
            key, digest, ids, start, starts, inner = (c[~mark] for c in (key, digest, ids, start, starts, kind == INNER))
            order, again = combined(ids, start, digest, key)
            key, digest, ids, start, starts, inner = (c[order] for c in (key, digest, ids, start, starts, inner))
            yield _batch([ids[again], start[again], starts[again], key[again], np.full(again.sum(), MARK)], "doc_id start starts key kind")
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            key, ids, start, starts, several = (c[new] for c in (key, ids, start, starts, inner))
            several[1:] |= key[1:] == key[:-1]
            several[:-1] |= key[1:] == key[:-1]
            yield _batch([ids[several], start[several], starts[several], key[several], np.full(several.sum(), RUN)], "doc_id start starts key kind")

    met = map_batches(map_batches(named, read, _FOUND).repartition("key").sortWithinPartitions("key"), meet, "doc_id long, start long, starts long, key long, kind long")
    met = written(met, "suffix-runs")
    asked = met.where(F.col("kind") == RUN)
    hot = asked.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    asked = asked.join(hot, "key", "left").groupBy("doc_id").agg(F.collect_list(F.struct("start", "starts", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            strings, cols, single = [], [[] for _ in range(3)], [[] for _ in range(3)]
            for i, z, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = unpack(z.as_py())
                for w in want:
                    part = text[w["start"] : w["start"] + w["starts"] + LENGTH - 1]
                    if len(part) < w["starts"] + LENGTH - 1:  # of another row with this id
                        continue
                    if w["hot"]:
                        h = _hashes(np.frombuffer(part, np.uint8))
                        for o, d in enumerate(_digest(h, np.arange(w["starts"])).view(np.int64)):
                            for c, v in zip(single, (int(d), i, w["start"] + o), strict=True):
                                c.append(v)
                    else:
                        strings.append(part)
                        for c, v in zip(cols, (w["key"], i, w["start"]), strict=True):
                            c.append(v)
            none = pa.nulls(0, pa.binary())
            if single[0]:
                key, ids, start = (np.array(c, np.int64) for c in single)
                told = _told(ids, start, np.ones(len(key), np.int64), key, key, np.zeros(len(key), bool))
                yield pa.RecordBatch.from_arrays([told.column(0), told.column(2), told.column(3), told.column(5), pa.array([b""] * len(told), pa.binary())], ["key", "doc_id", "start", "kind", "bytes"])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([RUN] * len(strings), pa.int64()), pa.array(strings, pa.binary()) if strings else none], ["key", "doc_id", "start", "kind", "bytes"])

    def sort(batches):
        def done(tables):
            t = pa.concat_tables(tables)
            key, ids, start, kind = (t.column(k).to_numpy() for k in range(4))
            mark = kind == MARK
            yield _batch([ids[mark], start[mark], np.ones(mark.sum())], "doc_id start starts")
            strings = t.column(4).to_pylist()
            single = ~mark & np.array([not s for s in strings])
            if single.any():  # single strings stand for themselves by their digest
                order, again = combined(ids[single], start[single], key[single])
                yield _batch([ids[single][order][again], start[single][order][again], np.ones(again.sum())], "doc_id start starts")
            rest = np.flatnonzero(~mark & ~single)
            hit = repeated([strings[k] for k in rest], key[rest].view(np.uint64), ids[rest], start[rest])
            hit = hit[np.lexsort((hit[:, 1], hit[:, 0]))]
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] + 1)
            at = np.flatnonzero(new)
            yield _batch([ids[rest][hit[at, 0]], start[rest][hit[at, 0]] + hit[at, 1], np.diff(np.r_[at, len(hit)])], "doc_id start starts")

        held, size = [], 0
        for t in _whole_keys(batches):
            held.append(t)
            size += t.nbytes
            if size > BLOCK_BYTES:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    fetched = map_batches(packed(named).join(asked, "doc_id").select("doc_id", "packed", "asked"), fetch, "key long, doc_id long, start long, kind long, bytes binary")
    shared = map_batches(fetched.repartition("key").sortWithinPartitions("key"), sort, "doc_id long, start long, starts long")
    return met.where(F.col("kind") == MARK).select("doc_id", "start", "starts").unionByName(shared)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): the texts' bytes, compressed, so that they are light to shuffle."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t.as_py() or "").encode("utf-8", "replace")) for t in b.column(1)], pa.binary())], ["doc_id", "packed"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, packed binary")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with the kept bytes if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = find(rows).groupBy("doc_id").agg(F.collect_list(F.struct("start", "starts")).alias("marks"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            cols, kept = [[] for _ in range(4)], []
            for z, m in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                text = unpack(z.as_py())
                change = np.zeros(len(text) + 1, np.int32)
                for x in m or ():
                    if x["start"] < len(text):
                        change[x["start"]] += 1
                        change[min(len(text), x["start"] + x["starts"] + LENGTH - 1)] -= 1
                gone = np.cumsum(change[:-1]) > 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if m else text
                kept.append(left)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(cols, (len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(v)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.binary())] if with_kept else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])])

    joined = packed(rows).join(marks, "doc_id", "left").select("doc_id", "packed", "marks")
    return map_batches(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else ""))
