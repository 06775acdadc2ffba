"""Iterative operators on edge tables; every round ends in a checkpoint."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import market
from tidegauge.operators.blocks import batch, block_pairs, dots, matrix, parts_for, widened
from tidegauge.operators.store import checkpointed, kept, written


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """Edges in parts by `src`, in its order, so that a round neither deals nor sorts them."""
    return kept(edges.repartition(n, "src").sortWithinPartitions("src"))


def _by_source(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges dealt into parts of a bounded size; and the parts."""
    raw = written(edges, "edges")
    n = parts_for(raw)
    return _dealt(raw, n), n


def _by_both(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Different edges (src, dst) dealt into parts of a bounded size, turned ones too; and the parts."""
    raw = written(edges, "edges")
    n = parts_for(raw)
    out = _dealt(raw.repartition(n, "src").distinct(), n)
    return out, _dealt(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")), n), n


def shortest_path(edges: DataFrame, source: int, cost: str = "cost") -> DataFrame:
    """(node, distance, parent) of all nodes reachable from a source, by relaxing edges until nothing changes. edges:
    (src, dst, cost), both directions where meant. A cycle of negative cost raises an error."""
    spark = edges.sparkSession
    e, n = _by_source(edges.select("src", "dst", F.col(cost).cast("double").alias("_c")))
    best = checkpointed(spark.createDataFrame([(source, 0.0, None)], "node long, distance double, parent long"))
    front, most_rounds = best, None
    for k in itertools.count(1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("_c")).alias("distance"), F.col("src").alias("parent"))
        both = best.withColumn("_new", F.lit(0)).unionByName(step.withColumn("_new", F.lit(1)))
        merged = checkpointed(both.repartition(n, "node").groupBy("node").agg(F.min(F.struct("distance", "_new", "parent")).alias("m")).select("node", "m.*"))
        front = merged.where("_new = 1").drop("_new")
        best = merged.select("node", "distance", "parent")
        if front.isEmpty():
            break
        if k % 100 == 0:  # a path without a cycle has fewer edges than there are nodes
            most_rounds = most_rounds or e.select("dst").distinct().count() + 1
            if k > most_rounds:
                raise ValueError("a cycle of negative cost")
    return best


def path_cost(path: DataFrame, edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Cost of a path (ord, node): the sum over its steps; null if a step has no edge."""
    from pyspark.sql import Window

    steps = path.select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy(F.lit(1)).orderBy("ord")).alias("dst")).where("dst is not null")
    joined = steps.join(edges.select("src", "dst", F.col(cost).alias("_c")), ["src", "dst"], "left")
    return joined.agg(F.when(F.count("*") == F.count("_c"), F.sum("_c")).alias("cost"))


def _inverse(p: Column, q: Column) -> Column:
    """The inverse of p modulo q, from 0 to q - 1, by the extended Euclidean algorithm; null if they have a common divisor."""
    start = F.struct(F.pmod(p, q).alias("a"), q.alias("b"), F.lit(1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, _: Column) -> Column:
        by = F.when(s["b"] != 0, F.floor(s["a"] / s["b"])).otherwise(0)
        done = s["b"] == 0
        return F.struct(F.when(done, s["a"]).otherwise(s["b"]).alias("a"), F.when(done, s["b"]).otherwise(s["a"] - by * s["b"]).alias("b"), F.when(done, s["x"]).otherwise(s["y"]).alias("x"), F.when(done, s["y"]).otherwise(s["x"] - by * s["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: F.when(s["a"] == 1, F.pmod(s["x"], q)))


def fraction_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst), both directions, of fractions that are neighbours: |p b - a q| = 1. nodes: (node, p, q), q over 0 and p and
    q under 2^31. Of two neighbours the one with the larger denominator knows the other: its denominator is the inverse of
    plus or minus p modulo q, so each fraction asks for two others by equality and no pairs are compared. Fractions that
    are not in lowest terms have no neighbours; equal fractions are neighbours of the same ones."""
    own = checkpointed(nodes.where("q > 0").select("node", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q")))  # so that inverses are of nodes, not of the rows they come from
    inverse = market.let(_inverse(F.col("p"), F.col("q")), lambda x: F.when(F.col("q") == 1, F.lit(1).cast("long")).otherwise(x))
    told = own.withColumn("inverse", inverse).where("inverse is not null")
    sides = told.select("node", "p", "q", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("inverse").alias("b")), F.struct(F.lit(-1).alias("sign"), F.when(F.col("q") == 1, 1).otherwise(F.col("q") - F.col("inverse")).alias("b")))).alias("s"))
    asked = sides.select(F.col("node").alias("src"), F.expr("(p * s.b - s.sign) div q").alias("p"), F.col("s.b").alias("q"))
    met = asked.join(own.withColumnRenamed("node", "dst"), ["p", "q"]).select("src", "dst")
    return met.unionByName(met.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, source: int) -> DataFrame:
    """(node, hops) of all nodes reachable from a source; each round only its new nodes move on."""
    spark = edges.sparkSession
    e, n = _by_source(edges.select("src", "dst"))
    seen = front = checkpointed(spark.createDataFrame([(source, 0)], "node long, hops int"))
    for k in itertools.count(1):
        reached = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).repartition(n, "node").distinct()
        front = checkpointed(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by passing on the smallest label, and jumping along labels, until nothing changes."""
    e = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = checkpointed(e.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("component")).withColumnRenamed("src", "node"))
    while True:
        near = e.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("_m"))
        moved = label.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_was"))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("_j"))
        new = checkpointed(moved.join(jump, "component", "left").select("node", F.least("component", "_j").alias("component"), "_was"))
        label = new.select("node", "component")
        if new.where("component < _was").isEmpty():
            break
    return label


def _sent(front: DataFrame, edges: DataFrame, n: int, value: Column) -> DataFrame:
    """(node, value): an aggregate of what rows of `front` (node, ...) send along edges that are dealt by source."""
    along = front.join(edges, F.col("node") == F.col("src")).drop("node", "src").withColumnRenamed("dst", "node")
    return along.repartition(n, "node").groupBy("node").agg(value)


def _trimmed(out: DataFrame, back: DataFrame, n: int) -> DataFrame:
    """(node) of nodes that keep an edge in and one out when others are taken off; only counts of edges change."""
    outs, ins = (kept(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias(c))) for e, c in ((out, "_outs"), (back, "_ins")))
    left = kept(outs.join(ins, "node"))
    gone = checkpointed(outs.join(ins, "node", "left_anti").select("node").union(ins.join(outs, "node", "left_anti").select("node")))
    while not (gone.isEmpty() or left.isEmpty()):
        fewer = left.join(_sent(gone, out, n, F.count("*").alias("_i")), "node", "left").join(_sent(gone, back, n, F.count("*").alias("_o")), "node", "left")
        now = kept(fewer.select("node", (F.col("_outs") - F.coalesce("_o", F.lit(0))).alias("_outs"), (F.col("_ins") - F.coalesce("_i", F.lit(0))).alias("_ins")))
        left, gone = now.where("_outs > 0 AND _ins > 0"), now.where("_outs = 0 OR _ins = 0").select("node")
    return left.select("node")


def _least_reaching(nodes: DataFrame, out: DataFrame, n: int) -> DataFrame:
    """(node, label): the smallest of `nodes` that reaches each of them over edges `out` among them, itself included."""
    label = front = kept(nodes.select("node", F.col("node").alias("label")))
    while True:
        offered = _sent(front, out, n, F.min("label").alias("_l"))
        moved = kept(label.join(offered, "node", "left").select("node", F.least("label", "_l").alias("label"), (F.col("_l") < F.col("label")).alias("_moved")))
        label, front = moved.select("node", "label"), moved.where("_moved").select("node", "label")
        if front.isEmpty():
            return label


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle of two nodes or more; component is the smallest node of the strongly connected set.

    Nodes without an edge in or out among those left are taken off. Of the rest, each node learns the smallest node that
    reaches it; those that reach that node back, over nodes which learned the same, form its set. Found sets are taken
    off too, until no edge is left. Edges are dealt once by source and once by target for each time that sets are taken off;
    between, only tables of nodes change. No step holds more rows than there are edges.
    """
    e = edges.select("src", "dst").where("src != dst")
    found = e.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        out, back, n = _by_both(e)
        nodes = _trimmed(out, back, n)
        if nodes.isEmpty():
            return found
        label, root = _least_reaching(nodes, out, n), F.col("node") == F.col("label")
        state = kept(label.select("node", "label", root.alias("_closed"), root.alias("_new")))
        while True:
            front = state.where("_new").select("node", "label")
            if front.isEmpty():
                break
            # a node's label is none that is smaller than its successors', so that the largest offered is the only one it can equal
            met = state.join(_sent(front, back, n, F.max("label").alias("_l")), "node", "left")
            new = ~F.col("_closed") & F.coalesce(F.col("_l") == F.col("label"), F.lit(False))
            state = kept(met.select("node", "label", (F.col("_closed") | new).alias("_closed"), new.alias("_new")))
        closed, left = state.where("_closed"), state.where("NOT _closed")
        big = closed.groupBy("label").agg(F.count("*").alias("_n")).where("_n > 1").select("label")
        found = found.union(closed.join(big, "label", "left_semi").select("node", F.col("label").alias("component")))
        if left.isEmpty():
            return found
        e = out.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def merge_redundant(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """(component, members, mean) of vectors of which each is parallel to another of its group but for a residual below
    eps. Unit vectors meet block by block, in which a matrix product picks the candidates whose residuals are then worked
    out in order; only near pairs leave a block."""
    u = df.select(F.col(key).alias("id"), market.normalized(F.col(vector).cast("array<double>")).alias("u"))
    kind = u.schema["id"].dataType.simpleString()
    whole = u.where(F.size("u") > 0).where("id is not null").select("id", F.transform("u", lambda x: F.coalesce(x, F.lit(0.0))).alias("u"))

    def parallel(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        types = {"src": left.schema.field("id").type, "dst": left.schema.field("id").type}
        x, y = matrix(left["u"])[0], matrix(right["u"])[0]
        x, y = (widened(z, max(x.shape[1], y.shape[1])) for z in (x, y))
        i, j, yt = left["id"].to_numpy(), right["id"].to_numpy(), np.ascontiguousarray(y.T)
        for at in range(0, len(i), 128):
            about = x[at : at + 128] @ yt
            r, c = np.nonzero(about * about > 1 - eps * eps - 1e-9)
            some = i[at + r] < j[c] if same else i[at + r] != j[c]
            r, c = at + r[some], c[some]
            cosine = dots(x[r].T, y[c].T)
            close = np.sqrt(np.maximum(0.0, 1 - cosine * cosine)) < eps
            if close.any():
                one, two = i[r[close]], j[c[close]]
                yield batch(types, src=np.where(one < two, one, two), dst=np.where(one < two, two, one))

    near = block_pairs(whole, "id", parallel, f"src {kind}, dst {kind}")
    named = u.join(components(near), u["id"] == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"), "u")
    mean = named.select("component", F.posexplode("u").alias("i", "x")).groupBy("component", "i").agg(F.avg("x").alias("x")).groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda a: a["x"]).alias("mean"))
    return named.groupBy("component").agg(F.count("*").alias("members")).join(mean, "component")


def ready_concepts(nodes: DataFrame, edges: DataFrame, learned: DataFrame) -> DataFrame:
    """(node, out_degree) of what is not learned yet but whose prerequisites all are. edges: src is needed for dst."""
    unmet = edges.join(learned.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("dst").alias("node")).distinct()
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_d"))
    open_ = nodes.select("node").join(learned, "node", "left_anti").join(unmet, "node", "left_anti")
    return open_.join(degree, "node", "left").select("node", F.coalesce("_d", F.lit(0)).alias("out_degree"))


def edge_costs(edges: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), normalize: bool = False) -> DataFrame:
    """(src, dst, cost) of (src, dst, curvature, interval, risk): a weighted sum, each part over its largest value where
    asked for; the cheaper of repeated edges, in both directions."""
    parts = [F.col(c) for c in ("curvature", "interval", "risk")]
    rows = edges
    if normalize:
        top = edges.agg(*[F.max(c).alias(f"_{i}") for i, c in enumerate(("curvature", "interval", "risk"))])
        rows = edges.join(F.broadcast(top), F.lit(True))
        parts = [F.when(F.col(f"_{i}") > 0, c / F.col(f"_{i}")).otherwise(0.0) for i, c in enumerate(parts)]
    cost = sum((w * c for w, c in zip(weights, parts, strict=True)), F.lit(0.0))
    one = rows.select("src", "dst", cost.alias("cost"))
    return one.union(one.select("dst", "src", "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
