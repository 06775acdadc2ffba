"""Numbers and running sums over ordered groups of any size, without a group in one task.

Rows are dealt by ranges of (group, order), sorted and written once, so that all later steps speak of the same ranges.
A group's ranges are then few rows, over which a window adds up what came before; within a range a row's place is known
from the order it was written in. Equal rows are told apart by their place in the input, so that a great many of them
spread over ranges too; the input should therefore be read from files, in which that place is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.store import written


def _ranges(df: DataFrame, by: list[str], order: list[str | Column], name: str, ranges: int | None = None) -> DataFrame:
    """df with _at, which grows along (by, order), and _range, written."""
    keys = [*by, *order, F.col("_salt")]
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).drop("_salt")
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))


def _joined(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """rows with what `ranges` says of their (by, _range); null is a group like any other."""
    other = ranges.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate([*by, "_range"])], *[c for c in ranges.columns if c not in (*by, "_range")])
    same = rows["_range"] == other[f"_of_{len(by)}"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(other[f"_of_{i}"])
    return rows.join(other, same).drop(*[f"_of_{i}" for i in range(len(by) + 1)])


def _windows(by: list[str]):
    group = Window.partitionBy(*(by or [F.lit(1)]))
    return group, group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], ordinal: str = "ordinal", rows: str = "group_rows") -> DataFrame:
    """df with each row's place in its group, from 0, and the number of the group's rows. Columns named _at, _range,
    _salt and _of_... are reserved."""
    held = _ranges(df, by, order, "numbered")
    group, before = _windows(by)
    ranges = held.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.select(*by, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias(rows))
    return _joined(held, ranges, by).withColumn(ordinal, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], row: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with, for each column of `sums`, the sum of it over the group's rows up to and with this one, under the name
    given. Null values count as nothing. `row` names a column for a number that is each row's own and grows with the
    order; `ranges` is how many there are, where the session is not to decide."""
    held = _ranges(df, by, order, "sums", ranges)
    _, before = _windows(by)
    ranges = held.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{name}") for c, name in sums.items()])
    ranges = ranges.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums.values()])
    inside = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_local_{name}") for c, name in sums.items()])
    out = _joined(local, ranges, by).withColumns({name: F.col(f"_before_{name}") + F.col(f"_local_{name}") for name in sums.values()})
    out = out.withColumn(row, F.col("_at")) if row else out
    return out.drop("_at", "_range", *[f"_{k}_{name}" for name in sums.values() for k in ("before", "local")])
