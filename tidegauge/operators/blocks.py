"""A table against all rows of another or of itself, in blocks of a checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, in expectation; each task holds one block.
MOST_ROWS = 20_000


#: Rows of a task at most, in expectation, where rows are sorted or aggregated by keys that hardly repeat.
TASK_ROWS = 2_000_000


def parts_for(rows: DataFrame) -> int:
    """Parts of some TASK_ROWS rows, as many as the session has at least; `rows` are counted, so they should be a table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def in_blocks(rows: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame], most: int = MOST_ROWS) -> DataFrame:
    """The union of `fn` over blocks of `rows`, each marked for broadcast. Rows are counted first; more than `most` are
    dealt out by a hash of `key`, which has to be nearly unique."""
    n = -(-rows.count() // most)
    if n <= 1:
        return fn(F.broadcast(rows))
    return reduce(DataFrame.unionByName, [fn(F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))) for k in range(n)])


def _blocks(rows: Column, most: int, least: int) -> Column:
    """Into how many blocks so many rows are dealt: `least`, so that there is work for all, but not of under some 1,000 rows,
    and more where blocks would have over `most`."""
    return F.greatest(F.lit(1), F.least(F.lit(least), F.ceil(rows / 1024)), F.ceil(rows / most)).cast("int")


def _by_groups(rows: DataFrame, cols: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, spread: int = 1) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(pa.Table.from_batches(list(batches)))

    n = spread * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks as the session has, however few the bytes
    return rows.repartition(n, *cols).groupBy(*cols).applyInArrow(run, schema)


def block_pairs(rows: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, by: list[str] | None = None, most: int = 16384, least: int = 16) -> DataFrame:
    """`fn(left, right, same)` over all pairs of blocks of rows that are equal in `by`, a block with itself among them (`same`).
    Blocks are dealt by a hash of `key`, and a pair of blocks is one group of some 2 * `most` rows at most, so that neither
    a group of any size nor all of its pairs are ever in one task."""
    by = by or []
    counts = rows.groupBy(*by).agg(_blocks(F.count("*"), most, least).alias("_n"))
    dealt = rows.join(counts, by) if by else rows.join(F.broadcast(counts), F.lit(True))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumn("_one", F.least("_own", "_other")).withColumn("_two", F.greatest("_own", "_other")).drop("_n", "_other")

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own, one, two = (t[c].to_numpy() for c in ("_own", "_one", "_two"))
        same = bool(one[0] == two[0])
        left = t.filter(pa.array(own == one))
        yield from fn(left, left if same else t.filter(pa.array(own == two)), same)

    return _by_groups(dealt, [*by, "_one", "_two"], meet, schema, spread=4)  # groups are large, and a hash deals them unevenly


def blocks_across(left: DataFrame, left_key: str, right: DataFrame, right_key: str, fn: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = 8192, most_right: int = 16384, least: int = 32) -> DataFrame:
    """`fn(left, right)` over all pairs of a block of `left` and a block of `right`, whose columns differ in name."""
    n, m = left.agg(_blocks(F.count("*"), most, 1).alias("_n")), right.agg(_blocks(F.count("*"), most_right, least).alias("_m"))
    sizes = F.broadcast(n.join(m, F.lit(True)))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = left.join(sizes, F.lit(True)).withColumn("_one", F.pmod(F.xxhash64(left_key), F.col("_n")).cast("int")).withColumn("_two", every("_m")).withColumn("_left", F.lit(True))
    b = right.join(sizes, F.lit(True)).withColumn("_two", F.pmod(F.xxhash64(right_key), F.col("_m")).cast("int")).withColumn("_one", every("_n")).withColumn("_left", F.lit(False))

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        first = t["_left"].to_numpy()
        if first.any() and not first.all():
            yield from fn(t.filter(pa.array(first)), t.filter(pa.array(~first)))

    return _by_groups(a.drop("_n", "_m").unionByName(b.drop("_n", "_m"), allowMissingColumns=True), ["_one", "_two"], meet, schema)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of doubles as rows padded with zeros, and their lengths, -1 for a null."""
    lists = column.combine_chunks()
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), -1), dtype=np.int64)
    flat, width = np.asarray(lists.flatten(), dtype=np.float64), max(int(sizes.max(initial=0)), 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out, sizes


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


#: Cells of a tile at most, but for one row: the tiles that a loop adds up stay in a core's cache.
TILE = 1 << 15


def tiles(n: int, m: int, same: bool, cells: int = TILE) -> Iterator[tuple[slice, int]]:
    """Some of n rows at a time, and the first of m columns that they meet; a block meets itself from its diagonal on."""
    at = 0
    while at < n:
        first = at if same else 0
        rows = max(1, cells // max(m - first, 1))
        yield slice(at, min(at + rows, n)), first
        at += rows


def apart(x: np.ndarray, y: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y, both transposed, their parts added from the first to the last. They lie in the first
    of pad's two rows, which the next tile takes anew: memory that is asked for with each tile costs more than the sums."""
    shape = x.shape[1], y.shape[1]
    pad = pad if pad.shape[1] >= shape[0] * shape[1] else np.empty((2, shape[0] * shape[1]), dtype=pad.dtype)
    total, step = (z[: shape[0] * shape[1]].reshape(shape) for z in pad)
    total[...] = 0
    for a, b in zip(x, y, strict=True):
        np.subtract(a[:, None], b[None, :], out=step)
        np.abs(step, out=step)
        total += step
    return total


def added(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first part to the last."""
    return np.add.reduce(np.ascontiguousarray(x.T), axis=0) if len(x) > 1 else np.add.accumulate(x, axis=1)[:, -1]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's `round` has it, without a decimal for each value: half up, by the digits that a value is written with."""
    up = 10.0**digits
    size = np.abs(x) * up
    whole = np.floor(size + 0.5)
    out = np.copysign(whole / up, x) + 0.0  # both are exact, so that the quotient is the nearest double
    near = np.abs(np.subtract(size, np.floor(size), out=np.zeros_like(size), where=size < 2.0**40) - 0.5) < 1e-4
    for i in np.flatnonzero(near | ~(size < 2.0**40)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e20 else x[i]
    return out


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, products summed from the first part to the last, as Spark's and SQL's lists are; x and y are transposed."""
    total = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def batch(like: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array(v, type=like.get(c)) for c, v in columns.items()})
