"""Nearest entries: on a line, by carrying the entries before and after over ranges; in space, by a tree of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import _joined, _ranges
from tidegauge.operators.store import written


def beside(queries: DataFrame, entries: DataFrame, by: list[str], at: str) -> DataFrame:
    """queries with `before` and `after`: the nearest entries of their group at or before, and after, their place; null
    where there is none. entries: (by, at, entry), one for each place. Both sides are dealt together by ranges of (by, at);
    windows look within a range, and what stands at the borders is carried over ranges, so that no group is one task."""
    kind = entries.schema["entry"].dataType.simpleString()
    asked = queries.select(*by, F.col(at), F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_query"), F.lit(None).cast(kind).alias("entry"))
    listed = entries.select(*by, F.col(at), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["_query"].dataType.simpleString()).alias("_query"), "entry")
    held = _ranges(listed.unionByName(asked), by, [at, "_kind"], "beside")
    place = F.when(F.col("entry").isNotNull(), F.col("_at"))
    ends = held.groupBy(*by, "_range").agg(F.max_by("entry", place).alias("_last"), F.min_by("entry", place).alias("_first"))
    group = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range")
    ends = ends.select(
        *by, "_range", F.last("_last", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried_before"),
        F.first("_first", ignorenulls=True).over(group.rowsBetween(1, Window.unboundedFollowing)).alias("_carried_after"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_at")
    seen = held.withColumn("_before", F.last("entry", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*by, "_range").orderBy(F.desc("_at"))
    seen = seen.withColumn("_after", F.last("entry", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 1")
    met = _joined(seen, ends, by)
    return met.select("_query.*", F.coalesce("_before", "_carried_before").alias("before"), F.coalesce("_after", "_carried_after").alias("after"))


#: Distinct keys of a cell, and the levels of cells there are: at the last one a cell may hold more.
CELL_KEYS, LEVELS = 512, 16


def _up(cell: str, level: Column) -> Column:
    """The cell of a level that holds a given one."""
    by = F.pow(F.lit(2.0), F.col(f"{cell}.level") - level)
    return F.struct(level.cast("int").alias("level"), *[F.floor(F.col(f"{cell}.x{i}") / by).alias(f"x{i}") for i in range(3)])


class Cells:
    """A tree of cells over three-part keys: a cell with more than `most` distinct keys is eight cells of the next level.
    Only cells with keys are there. A dense clump is therefore many small cells and an empty space none."""

    def __init__(self, keys: DataFrame, names: list[str], most: int = CELL_KEYS, levels: int = LEVELS):
        self.names, self.levels = names, levels
        box = keys.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
        self.low = [float(box[f"lo_{n}"] or 0.0) for n in names]
        self.side = max([float((box[f"hi_{n}"] or 0.0) - lo) for n, lo in zip(names, self.low, strict=True)] + [1e-300]) * (1 + 1e-9)
        placed = written(keys.withColumn("finest", self.cell([F.col(n) for n in names])), "cells")
        counts = placed.groupBy("finest").agg(F.count("*").alias("n"))
        levels_of = counts.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _up("finest", k))).alias("cell")).groupBy("cell").agg(F.sum("n").alias("n"))
        self.counts = written(levels_of, "cell-counts")
        full = self.counts.where((F.col("n") > most) & (F.col("cell.level") < levels)).select("cell")
        root = self.counts.where("cell.level = 0").select("cell", "n")
        inner = self.counts.where("cell.level > 0").withColumn("parent", _up("cell", F.col("cell.level") - 1))
        split = inner.join(full.withColumnRenamed("cell", "parent"), "parent").select("cell", "n").unionByName(root)
        self.leaves = written(split.join(full, "cell", "left_anti"), "cell-leaves")
        paths = counts.select("finest", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _up("finest", k))).alias("cell"))
        self.rows = written(placed.join(paths.join(self.leaves.select("cell"), "cell"), "finest").drop("finest"), "cell-rows")

    def cell(self, places: list[Column], level: int | None = None) -> Column:
        """The cell of a point at a level, the last one if none is given; points outside get cells outside."""
        k = self.levels if level is None else level
        width = self.side / 2.0**k
        return F.struct(F.lit(k).alias("level"), *[F.floor((p - lo) / width).alias(f"x{i}") for i, (p, lo) in enumerate(zip(places, self.low, strict=True))])

    def reach(self, point: list[Column], cell: str, farthest: bool) -> Column:
        """Distance from a point to the farthest or nearest place of a cell, with a little room for rounding."""
        width = self.side / F.pow(F.lit(2.0), F.col(f"{cell}.level"))
        total = F.lit(0.0)
        for i, (p, lo) in enumerate(zip(point, self.low, strict=True)):
            a, b = F.col(f"{cell}.x{i}") * width + lo, (F.col(f"{cell}.x{i}") + 1) * width + lo
            off = F.greatest(F.abs(p - a), F.abs(p - b)) if farthest else F.greatest(a - p, p - b, F.lit(0.0))
            total = total + off * off
        return F.sqrt(total) * (1 + 1e-9) + 1e-12 if farthest else F.sqrt(total) * (1 - 1e-9) - 1e-12 * self.side


def nearest_in_space(queries: DataFrame, memory: DataFrame, n: int, names: list[str], most: int = CELL_KEYS, levels: int = LEVELS) -> DataFrame:
    """(q, distance, rank, and memory's columns) of the n rows of `memory` nearest to each query by a three-part key, ties
    to the smaller id. queries: (q, names); memory: (id, names, ...). Keys that are null or not finite are far from all.

    The k-th distance is bounded by the farthest place of the smallest cell around the query that holds n distinct keys,
    then by the keys of the query's own cell; only cells within the bound are met. All joins are on cells; rows of one key
    are met as one key, with its n smallest ids."""
    sound = lambda df: df.where(" AND ".join(f"isnotnull({c}) AND NOT isnan({c}) AND abs({c}) < 1e300" for c in names))
    narrow = sound(memory.select("id", *[F.col(c).cast("double").alias(c) for c in names]))
    dealt = narrow.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_part").orderBy("id"))).where(F.col("_r") <= n)  # so that a much-repeated key is never one task
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).where(F.col("_r") <= n).select("id", *names)
    keys = written(kept.groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids")), "space-keys")
    cells = Cells(keys, names, most, levels)
    point = [F.col(f"_{c}") for c in names]
    asked = written(sound(queries.select("q", *[F.col(c).cast("double").alias(c) for c in names])).select("q", *[F.col(c).alias(f"_{c}") for c in names]), "space-queries")

    around = asked.select("*", F.explode(F.array(*[cells.cell(point, k) for k in range(levels + 1)])).alias("cell"))
    holding = around.join(cells.counts.where(F.col("n") >= n).select("cell"), "cell").groupBy("q").agg(F.min(cells.reach(point, "cell", True)).alias("bound"))
    root = F.struct(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(f"x{i}") for i in range(3)])
    outer = asked.withColumn("cell", root).select("q", *point, cells.reach(point, "cell", True).alias("most"))
    far = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in names), F.lit(0.0)))
    ranked = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("distance"))).where(F.col("_r") <= n)
    own = around.join(cells.rows, "cell").select("q", far.alias("distance"))
    near = ranked(own).groupBy("q").agg(F.when(F.count("*") >= n, F.max("distance") * (1 + 1e-9) + 1e-12).alias("bound_own"))
    bounded = outer.join(holding, "q", "left").join(near, "q", "left")
    bounded = written(bounded.select("q", *point, F.least("most", "bound", "bound_own").alias("bound")), "space-bounds")

    # cells of the level at which a cell is at least as wide as the bound: 27 of them hold all that is within it
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(cells.side / F.greatest(F.col("bound"), F.lit(cells.side / 2.0**levels)))))).cast("int")
    width = cells.side / F.pow(F.lit(2.0), F.col("level"))
    probes = bounded.withColumn("level", level).withColumn("mid", F.array(*[F.floor((p - lo) / width) for p, lo in zip(point, cells.low, strict=True)]))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    probes = probes.select("q", *point, "bound", F.explode(F.transform(steps, lambda s: F.struct(F.col("level").alias("level"), *[(F.col("mid")[i] + s[x]).alias(f"x{i}") for i, x in enumerate("ijk")]))).alias("probe"))
    probes = probes.where(cells.reach(point, "probe", False) <= F.col("bound"))
    up = F.transform(F.sequence(F.lit(0), F.col("probe.level")), lambda k: _up("probe", k))
    over = probes.select("q", *point, "bound", F.explode(up).alias("leaf")).join(cells.leaves.select(F.col("cell").alias("leaf")), "leaf")
    deep = cells.leaves.where("cell.level > 0")
    down = deep.select(F.col("cell").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(0), F.col("cell.level") - 1), lambda k: _up("cell", k))).alias("probe"))
    under = probes.join(down, "probe").select("leaf", "q", *point, "bound")
    reached = over.unionByName(under).where(cells.reach(point, "leaf", False) <= F.col("bound")).distinct()
    met = reached.join(cells.rows.withColumnRenamed("cell", "leaf"), "leaf").select("q", "bound", far.alias("distance"), "ids").where("distance <= bound")
    by_key = met.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("distance", F.col("ids")[0]))).where(F.col("_r") <= n)
    rows = by_key.select("q", "distance", F.explode("ids").alias("id"))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= n)
    return memory.join(best, "id")
