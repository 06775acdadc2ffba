"""Line dedup over exact reference counts, with sharded cuckoo filters in front of them; reversible.

A line's key is the line without white space at both ends, in lower case for A-Z. Keys of at least `least_chars` code
points that at least `least_docs` documents hold lose all their lines except those of the largest id holding them.

State is three tables, in shards by the first bits of the key's digest: postings (key, doc_id, n_lines), the exact
reference counts derived from them (key, n_docs, last_doc), and a cuckoo filter of each shard's live keys. Inserting documents
probes the filters first: keys that no filter knows are new and need no look at the counts. Deleting documents takes
their postings out, lowers the counts, and removes keys that no document holds any more from the filters, so that
insertions are undone exactly. A filter that is full is made anew, larger, from its shard's counts; once shards hold twice
the keys they are meant for, all are split. Applying an index probes filters of the keys that are over the threshold, and
only their hits are compared with the exact counts; where these filters would take over 32 MB they are not made, and all
keys meet the counts in that same join. `save` and `load` keep an index as files.

Null and empty texts are one empty line. Rows with a null id neither count nor lose lines. Repeated rows of an id are
one document, whose lines all count once; each of the rows loses its lines. Empty tables give empty ones. Other
columns are carried along where named in `keep`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import WHITE, map_batches, written

#: Keys of a shard in a new index, and the most bytes of filters that tasks get by broadcast; beyond, exact joins only.
SHARD_KEYS, MOST_FILTER_BYTES = 40_000, 32_000_000


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key has two buckets. Keys are (a, b) pairs of 64-bit halves of a digest."""

    def __init__(self, buckets: int = 16):
        self.table = np.zeros((buckets, 4), np.uint16)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, fill: bool = True) -> CuckooFilter:
        """A filter with room for twice as many keys."""
        f = cls(1 << max(4, math.ceil(math.log2(max(1, len(a)) / 2))))
        if fill:
            f.insert(a, b)
        return f

    def _places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (b & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = a & mask
        return mark, one.astype(np.int64), (one ^ self._hop(mark)).astype(np.int64)

    def _hop(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(a, b)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, a: np.ndarray, b: np.ndarray) -> None:
        """Raises OverflowError, before which the filter may have taken some keys, when it is too full."""
        t, rng = self.table, np.random.default_rng(len(a))
        mark, one, two = self._places(a, b)
        for k in self._seated(mark, one, two):
            x, at = mark[k], one[k]
            for _ in range(500):
                slot = rng.integers(4)
                x, t[at, slot] = t[at, slot], x
                at = int(np.uint64(at) ^ self._hop(np.array([x], np.uint16))[0])
                free = np.flatnonzero(t[at] == 0)
                if len(free):
                    t[at, free[0]] = x
                    break
            else:
                raise OverflowError("the filter is full")

    def _seated(self, mark: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Puts keys into free slots of their first and then their second buckets; gives those for which none was left."""
        t, left = self.table, np.arange(len(mark))
        for place in (one, two):
            order = left[np.argsort(place[left], kind="stable")]
            bucket = place[order]
            first = np.searchsorted(bucket, bucket, "left")
            free = np.cumsum(t[bucket] == 0, axis=1)
            nth = np.arange(len(bucket)) - first + 1  # a bucket's keys take its free slots in turn
            fits = nth <= free[:, -1]
            slot = (free >= nth[:, None]).argmax(1)
            t[bucket[fits], slot[fits]] = mark[order[fits]]
            left = order[~fits]
        return left

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for mark, one, two in zip(*self._places(a, b), strict=True):
            for place in (one, two):
                here = np.flatnonzero(self.table[place] == mark)
                if len(here):
                    self.table[place, here[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        f = cls(struct.unpack_from("<q", blob)[0])
        f.table = np.frombuffer(blob, np.uint16, offset=8).reshape(-1, 4).copy()
        return f


def line_keys(text: str | None, least_chars: int) -> list[bytes | None]:
    """Each line's digest (16 bytes), or nothing for short ones."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        bare = line.strip(WHITE) if len(line) >= least_chars else ""
        out.append(hashlib.md5(bare.encode("utf-8", "replace").lower()).digest() if len(bare) >= least_chars else None)
    return out


@dataclass(frozen=True)
class Index:
    """postings (a, b, doc_id, n_lines), counts (a, b, n_docs, last_doc), filters (shard, n_keys, filter)."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame | None
    least_chars: int
    shard_bits: int


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("a", 64 - bits).cast("int") if bits else F.lit(0)


def _halves(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["b"].to_numpy(np.int64).view(np.uint64)


def _postings(docs: DataFrame, least_chars: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, ids, ns = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: dict[bytes, int] = {}
                for k in line_keys(t.as_py(), least_chars):
                    if k:
                        held[k] = held.get(k, 0) + 1
                keys += held
                ns += held.values()
                ids += [i] * len(held)
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], ["a", "b", "doc_id", "n_lines"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "a long, b long, doc_id long, n_lines long").groupBy("a", "b", "doc_id").agg(F.sum("n_lines").alias("n_lines"))


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _filled(a: np.ndarray, b: np.ndarray) -> CuckooFilter:
    f, size = CuckooFilter.of(a, b, fill=False), 0
    while True:
        try:
            f.insert(a, b)
            return f
        except OverflowError:
            size = 2 * len(f.table)
            f = CuckooFilter(size)


_FILTERS = "shard int, n_keys long, filter binary"


def build_filters(keys: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, n_keys, filter) of distinct keys (a, b); a task holds a shard's keys at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(pdf)], "filter": [_filled(*_halves(pdf)).to_bytes()]})

    return keys.select(_shard(shard_bits).alias("shard"), "a", "b").groupBy("shard").applyInPandas(run, _FILTERS)


def _bits(counts: DataFrame) -> int:
    return max(0, math.ceil(math.log2(max(1, counts.count()) / SHARD_KEYS)))


def build(docs: DataFrame, least_chars: int = 40, with_filters: bool = True) -> Index:
    """An index of all rows of `docs`, in the shared checkpoint folder. Without filters it can only be applied, and its
    postings are not kept."""
    postings = _postings(docs, least_chars)
    postings = written(postings, "line-postings") if with_filters else postings
    counts = written(_counts(postings), "line-counts")
    bits = _bits(counts)
    return Index(postings, counts, written(build_filters(counts, bits), "line-filters") if with_filters else None, least_chars, bits)


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with more documents. Ids that are indexed already have to be deleted first: they are an error."""
    new = written(_postings(docs, index.least_chars), "line-postings")
    if not new.join(index.postings.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("documents of these ids are in the index: delete them first")

    def probe(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.zeros(len(left), bool)
        if len(right) and len(left):
            known = CuckooFilter.from_bytes(right["filter"].iloc[0]).contains(*_halves(left))
        return left.assign(known=known)[["a", "b", "n_docs", "last_doc", "known"]]

    fresh = _counts(new).withColumn("shard", _shard(index.shard_bits))
    probed = fresh.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(probe, "a long, b long, n_docs long, last_doc long, known boolean")
    probed = written(probed, "line-probed")
    again, first = probed.where("known").drop("known"), probed.where("not known").drop("known")
    counts = index.counts
    if not again.isEmpty():  # only keys that a filter may know are looked up
        counts = counts.unionByName(again).groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    counts = written(counts.unionByName(first), "line-counts")
    postings, bits = written(index.postings.unionByName(new), "line-postings"), _bits(counts)
    if bits > index.shard_bits + 1:
        return replace(index, postings=postings, counts=counts, filters=written(build_filters(counts, bits), "line-filters"), shard_bits=bits)
    added = first.select("a", "b").unionByName(again.join(index.counts, ["a", "b"], "left_anti").select("a", "b"))
    filters = _updated(index, added, True)
    full = filters.where("filter is null").select("shard")
    if not full.isEmpty():
        anew = build_filters(counts.withColumn("shard", _shard(index.shard_bits)).join(full, "shard", "left_semi"), index.shard_bits)
        filters = written(filters.where("filter is not null").unionByName(anew), "line-filters")
    return replace(index, postings=postings, counts=counts, filters=filters)


def delete(index: Index, doc_ids: DataFrame) -> Index:
    """The index without the documents of the ids given (doc_id)."""
    ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    gone = written(index.postings.join(ids, "doc_id", "left_semi").select("a", "b").distinct(), "line-gone")
    postings = written(index.postings.join(ids, "doc_id", "left_anti").select("a", "b", "doc_id", "n_lines"), "line-postings")
    touched = _counts(postings.join(gone, ["a", "b"], "left_semi"))
    counts = written(index.counts.join(gone, ["a", "b"], "left_anti").unionByName(touched), "line-counts")
    dead = gone.join(counts, ["a", "b"], "left_anti")
    return replace(index, postings=postings, counts=counts, filters=_updated(index, dead, False))


def _updated(index: Index, keys: DataFrame, add: bool) -> DataFrame:
    def run(key, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        a, b = _halves(change)
        n = int(old["n_keys"].iloc[0]) if len(old) else 0
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else _filled(a, b)
        blob = None
        try:
            if len(old):
                (f.insert if add else f.delete)(a, b)
            blob = f.to_bytes()
        except OverflowError:  # told by having no filter
            pass
        return pd.DataFrame({"shard": [key[0]], "n_keys": [n + len(a) if add else n - len(a)], "filter": [blob]})

    changes = keys.select(_shard(index.shard_bits).alias("shard"), "a", "b")
    return written(index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, _FILTERS), "line-filters")


def save(index: Index, path: str) -> None:
    """The index as Parquet tables in a folder."""
    for name in ("postings", "counts", "filters"):
        if (df := getattr(index, name)) is not None:
            df.write.parquet(f"{path}/{name}")
    index.counts.sparkSession.createDataFrame([(index.least_chars, index.shard_bits, index.filters is not None)], "least_chars int, shard_bits int, filtered boolean").write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()  # one row
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("postings"), read("counts"), read("filters") if about.filtered else None, about.least_chars, about.shard_bits)


#: Bytes of filter that a key may take: two to four slots of two bytes, and a filter's least size.
_KEY_BYTES = 8


def _shared(keys: DataFrame, shard_bits: int):
    """Filters of the keys for all tasks, by shard, if they are small enough together; else nothing is made."""
    if keys.count() * _KEY_BYTES + (128 << shard_bits) > MOST_FILTER_BYTES:
        return None
    return keys.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in build_filters(keys, shard_bits).collect()})


def apply(index: Index, docs: DataFrame, least_docs: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs`, which the index has, with its lines thinned out: the columns `keep`, then text, n_lines
    (before), n_dropped. Texts without a hit in the filters are finished where they are read; only the others meet
    their confirmed keys in a shuffle."""
    often = written(index.counts.where(F.col("n_docs") >= least_docs).select("a", "b", "last_doc"), "line-often")
    shared, least_chars, bits = _shared(often, index.shard_bits), index.least_chars, index.shard_bits
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(keep or ["doc_id"])).alias("row"), F.col("text").cast("string").alias("text"))
    row = rows.schema["row"].dataType.simpleString()

    def probe(batches):
        filters = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()} if shared else None
        for batch in batches:
            keys, owners, lines = [], [], []
            for i, t in enumerate(batch.column(2)):
                found = line_keys(t.as_py(), least_chars)
                lines.append(len(found))
                for k in set(found) - {None}:
                    keys.append(k)
                    owners.append(i)
            k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            hit = np.ones(len(k), bool)
            if filters is not None:
                shard = (k[:, 0] >> np.uint64(64 - bits)).astype(int) if bits else np.zeros(len(k), int)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    hit[at] = filters[s].contains(k[at, 0], k[at, 1]) if s in filters else False
            held: list[list[dict]] = [[] for _ in lines]
            signed = k.view(np.int64)
            for j in np.flatnonzero(hit):
                held[owners[j]].append({"a": int(signed[j, 0]), "b": int(signed[j, 1])})
            pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lines, pa.int64()), pa.array(held, pa.list_(pair))], ["doc_id", "row", "text", "n_lines", "held"])

    def thin(batches):
        for batch in batches:
            texts, dropped = [], []
            for t, gone in zip(batch.column(1), batch.column(3), strict=True):
                t, gone = t.as_py() or "", {struct.pack("<qq", g["a"], g["b"]) for g in gone.as_py() or ()}
                lines = t.split("\n")
                left = [x for x, k in zip(lines, line_keys(t, least_chars), strict=True) if k not in gone] if gone else lines
                texts.append("\n".join(left))
                dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    probed = map_batches(rows, probe, f"doc_id long, row {row}, text string, n_lines long, held array<struct<a:bigint,b:bigint>>")
    hit = (F.size("held") > 0) & F.col("doc_id").isNotNull()
    done = probed.where(~hit).select("row.*", F.coalesce("text", F.lit("")).alias("text"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    named = probed.where(hit).select("doc_id", F.explode("held").alias("k")).select("doc_id", "k.a", "k.b")
    gone = named.join(often, ["a", "b"]).where("doc_id != last_doc").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    thinned = map_batches(probed.where(hit).join(gone, "doc_id", "left").select("row", "text", "n_lines", "gone"), thin, f"row {row}, text string, n_lines long, n_dropped long")
    return thinned.select("row.*", "text", "n_lines", "n_dropped").unionByName(done)
