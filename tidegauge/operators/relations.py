"""Top-k, set operations, grids and libraries of equations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.blocks import parts_for
from tidegauge.operators.ordering import running_sums


def top_k(df: DataFrame, score: str, k: int, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """The k rows with the largest score, ranked; within groups where given. The limit is taken before the shuffle too."""
    order = [F.desc(score), *[F.col(t) for t in ties or []]]
    if not by:
        df = df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order))).where(F.col("rank") <= k)


def frequency_response(designs: DataFrame, n: int, step: float) -> DataFrame:
    """Gain of the resistor in series RLC designs (r, l, c) at n angular frequencies, and their class by Q."""
    grid = designs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", step * (F.col("k") + 1))
    reactance = F.col("w") * F.col("l") - 1 / (F.col("w") * F.col("c"))
    q = F.sqrt(F.col("l") / F.col("c")) / F.col("r")
    return grid.withColumn("gain", F.col("r") / F.hypot(F.col("r"), reactance)).withColumn("class", F.when(q > 0.5, "underdamped").when(q == 0.5, "critical").otherwise("overdamped"))


def clearing_time(machines: DataFrame, zetas: list[float], a: float, hertz: float = 60.0) -> DataFrame:
    """Closed-form fault clearing time of machines (h, p_m, p_max) by the equal-area angle, corrected for damping."""
    d0 = F.asin(F.least(F.col("p_m") / F.col("p_max"), F.lit(1.0)))
    dc = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (math.pi - 2 * d0) * F.sin(d0) - F.cos(d0))))
    inertia = 2 * F.col("h") / (2 * math.pi * hertz)
    grid = machines.withColumn("zeta", F.explode(F.array(*[F.lit(z) for z in zetas])))
    return grid.withColumn("clearing", F.sqrt(2 * inertia * (dc - d0) / F.col("p_m")) / (1 - a * F.col("zeta")))


def build_library(equations: DataFrame) -> DataFrame:
    """Equal equations (by text without white space) as one: its domains, papers and first sight. equations: (ord,
    paper_id, domain, latex)."""
    canon = F.regexp_replace("latex", r"\s+", "")
    return equations.groupBy(canon.alias("canonical")).agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("paper_id")).alias("papers"), F.min("ord").alias("first"))


def universal_functions(library: DataFrame, k: int) -> DataFrame:
    return library.where(F.size("domains") >= k)


def assign_dims(library: DataFrame, key: str, foundational: Column, width: Column, buckets: int | None = None) -> DataFrame:
    """First slot of each entry in order of priority (foundational first, then more domains, then key). Ranges of entries
    are written once and summed from there, so that no task sorts all entries."""
    rank = F.struct(F.when(foundational, 0).otherwise(1).alias("f"), (-F.size("domains")).alias("n"), F.col(key).alias("k"))
    rows = running_sums(library.withColumn("_width", width).withColumn("_rank", rank), [], ["_rank"], {"_width": "_end"}, ranges=buckets)
    return rows.withColumn("first_dim", F.col("_end") - F.col("_width")).drop("_width", "_rank", "_end")


def merge_discoveries(df: DataFrame, centers: DataFrame, near: float = 0.1) -> DataFrame:
    """Points (id, instance, x, y, value) moved by their instance's centre (instance, cx, cy); of points nearer than
    `near` the one with the larger value (then the smaller id) stays; a point goes if any better one is near."""
    p = df.join(centers, "instance").select("id", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"), "value")
    cell = lambda c, d=0: F.floor(F.col(c) / near) + d
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = p.withColumn("_o", F.explode(around)).withColumn("_cx", cell("x") + F.col("_o.i")).withColumn("_cy", cell("y") + F.col("_o.j"))
    right = p.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("value").alias("_v"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    better = (F.col("_v") > F.col("value")) | ((F.col("_v") == F.col("value")) & (F.col("_id") < F.col("id")))
    beaten = left.join(right, ["_cx", "_cy"]).where((F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) < near) & better).select("id").distinct()
    return p.join(beaten, "id", "left_anti")


def graph_summary(nodes: DataFrame, edges: DataFrame, kind: str, of: str) -> DataFrame:
    """One row: nodes, undirected edges, and the share of nodes of one kind. Edges are counted, then dealt in parts of a bounded
    size; they should be a table."""
    n = nodes.agg(F.count("*").alias("nodes"), F.avg((F.col(kind) == of).cast("double")).alias("share"))
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).repartition(parts_for(edges), "a", "b").distinct().agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(e), F.lit(True))


def classify_pattern(df: DataFrame, key: str, value: str, domain: str, conserved: Column) -> DataFrame:
    """`statistical` if the values vary, few domains have it, or it is not conserved; else `deterministic`."""
    g = df.groupBy(key).agg(F.var_pop(value).alias("variance"), F.size(F.collect_set(domain)).alias("domains"), F.bool_and(conserved).alias("conserved"))
    return g.withColumn("kind", F.when((F.col("variance") > 0.1) | (F.col("domains") < 3) | ~F.col("conserved"), "statistical").otherwise("deterministic"))


def order_by_difficulty(dirs: DataFrame, name: str, depth: str) -> DataFrame:
    """Challenge folders at most three levels deep, from basic to expert."""
    from tidegauge.functions.text import difficulty

    kept = dirs.where(F.lower(name).rlike("challenge|exercise|problem") & (F.col(depth) <= 3))
    return kept.withColumn("difficulty", difficulty(F.col(name))).orderBy("difficulty", name)


def hotspots(modules: DataFrame, k: int) -> DataFrame:
    """The k most complex modules."""
    return modules.orderBy(F.desc("complexity"), "module").limit(k)


def rank_for_gap(repos: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """(gap, repo, relevance, rank): the k repositories whose words share most with each gap's. repos: (repo, words), in
    any number of rows a repository; gaps: (gap, words)."""
    r = repos.select("repo", F.explode(F.array_distinct("words")).alias("w")).distinct()
    g = gaps.select("gap", F.explode(F.array_distinct("words")).alias("w"), F.size(F.array_distinct("words")).alias("_n"))
    score = g.join(r, "w").groupBy("gap", "repo").agg((F.count("*") / F.max("_n")).alias("relevance"))
    return top_k(score, "relevance", k, ["gap"], ["repo"])


def mask_gaps(masks: DataFrame, dim: int, least: float) -> DataFrame:
    """Domains (domain, dim) whose share of active places is under `least`."""
    return masks.groupBy("domain").agg((F.countDistinct("dim") / dim).alias("density")).where(F.col("density") < least)


def repo_page(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, summary, steps): the first long paragraph, and the headings as steps, or the usual ones without any."""
    from tidegauge.functions.text import headings, summary

    steps = F.transform(headings(F.col(html)), lambda h: h["text"])
    usual = F.array(*[F.lit(s) for s in ("install", "configure", "run")])
    return df.select(key, summary(F.col(html)).alias("summary"), F.when(F.size(steps) > 0, steps).otherwise(usual).alias("steps"))


def compare_domains(profiles: DataFrame, domain: str, profile: str, n: int, least: float = 0.7) -> DataFrame:
    """(a, b, similarity, universal) of domains' resampled profiles; universal if every pair is over `least`."""
    from tidegauge.operators.regimes import compare_profiles, profile_signature

    p = profiles.select(F.col(domain).alias("d"), profile_signature(F.col(profile), n).alias("s"))
    pairs = p.alias("x").join(p.alias("y"), F.col("x.d") < F.col("y.d")).select(F.col("x.d").alias("a"), F.col("y.d").alias("b"), compare_profiles(F.col("x.s"), F.col("y.s")).alias("similarity"))
    return pairs.withColumn("universal", F.min("similarity").over(Window.partitionBy(F.lit(1))) > least)


def bench_summary(df: DataFrame, error: str, ratio: str) -> DataFrame:
    return df.agg(F.avg(F.abs(error)).alias("mean_error"), F.max(F.abs(error)).alias("max_error"), F.avg(ratio).alias("mean_ratio"))
