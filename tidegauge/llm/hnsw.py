"""Approximate nearest neighbours: a hierarchical navigable small-world graph in each shard, results merged.

Vectors that are equal are one point, whose ids come along. Points are dealt to shards of about `shard_points` by a hash
of the vector. A task builds one shard's graph: points get a random level (by a hash, so that a lost task builds the
same graph again), and in order of arrival each links, on every level it is on, to the diverse nearest of those before
it; links are two-way and pruned to the level's degree by the same rule. Neighbours stand in flat arrays, a row of
fixed width for each point of a level. A search descends greedily, then keeps the `ef` best on the lowest level. Every
query, in blocks, searches every shard of its dimension; the k best of all shards are scored on the original vectors in
double precision.

Vectors that are null, empty, zero, or hold null or non-finite parts take no part. Equal scores: the smaller id.
Repeated rows of an id are one candidate if their vectors are equal; a query's own id never is its candidate. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

SHARD_POINTS, DEGREE, EF = 8192, 16, 96
#: Queries that meet a copy of a shard's graph in one task, about as many bytes as the graph has, and of those at a time.
BLOCK_QUERIES, AT_ONCE = 8192, 256


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which leaves its cosines exactly as they are, so that squares stay finite."""
    return np.ldexp(v.astype(np.float64), -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _diverse(near: np.ndarray, sims: np.ndarray, unit: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to the point than to any chosen before; filled up in order."""
    chosen: list[int] = []
    among = unit[near] @ unit[near].T
    left = np.ones(len(near), bool)
    for i in range(len(near)):
        if left[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            left &= among[i] <= sims
            left[: i + 1] = False
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [i for i in range(len(near)) if i not in taken][: most - len(chosen)]
    return [int(near[i]) for i in chosen]


class Graph:
    """One shard: unit vectors, and for each level the points on it and their neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.unit = _unit(vectors)
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(degree)).astype(int), 6)
        top = int(level.max()) if n else 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(top + 1):
            points = np.flatnonzero(level >= k)
            self.levels.append((points, self._link(points, degree * 2 if k == 0 else degree)))
        self.entry = int(self.levels[-1][0][0]) if n else -1

    def _link(self, points: np.ndarray, width: int, block: int = 512) -> np.ndarray:
        unit, m = self.unit[points], len(points)
        links: list[list[int]] = [[] for _ in range(m)]
        half = width // 2
        for s in range(0, m, block):
            e = min(m, s + block)
            sims = unit[s:e] @ unit[:e].T
            sims[np.arange(e)[None, :] >= np.arange(s, e)[:, None]] = -2  # only those before it
            pool = min(e, width * 2)
            best = np.argpartition(-sims, pool - 1, axis=1)[:, :pool] if pool < e else np.tile(np.arange(e), (e - s, 1))
            for i in range(s, e):
                c = best[i - s]
                v = sims[i - s, c]
                order = np.argsort(-v, kind="stable")
                order = order[v[order] > -2]
                for j in _diverse(c[order], v[order], unit, half):
                    links[i].append(j)
                    links[j].append(i)
        flat = np.full((m, width), -1, np.int32)
        for i, own in enumerate(links):
            if len(own) > width:
                c = np.array(own)
                v = unit[c] @ unit[i]
                order = np.argsort(-v, kind="stable")
                own = _diverse(c[order], v[order], unit, width)
            flat[i, : len(own)] = own
        return flat

    def search(self, queries: np.ndarray, k: int, ef: int = EF) -> list[np.ndarray]:
        """Each query's nearest points, best first, at least k where the shard has them."""
        q, n = _unit(queries), len(self.unit)
        ef = max(ef, k)
        at = np.full(len(q), self.entry)
        for points, flat in reversed(self.levels[1:]):
            where = np.full(n, -1, np.int32)
            where[points] = np.arange(len(points))
            score = np.einsum("ij,ij->i", q, self.unit[at])
            moving = np.ones(len(q), bool)
            while moving.any():
                near = flat[where[at]]
                sims = np.where(near >= 0, np.einsum("ij,ikj->ik", q, self.unit[points[np.maximum(near, 0)]]), -2)
                best = sims.argmax(1)
                better = sims[np.arange(len(q)), best]
                moving = better > score
                at = np.where(moving, points[near[np.arange(len(q)), best]], at)
                score = np.maximum(score, better)
        flat, rows = self.levels[0][1], np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        ids, sims, done = np.full((len(q), ef), -1), np.full((len(q), ef), -2.0, np.float32), np.ones((len(q), ef), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, np.einsum("ij,ij->i", q, self.unit[at]), False
        seen[rows, at] = True
        while True:
            open_ = np.where(done, -3.0, sims)
            pick = open_.argmax(1)
            live = np.flatnonzero(open_[rows, pick] > -3)
            if not len(live):
                break
            p = ids[live, pick[live]]
            done[live, pick[live]] = True
            near = flat[p]
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(new, near, n)] = True
            s = np.where(new, np.einsum("ij,ikj->ik", q[live], self.unit[np.maximum(near, 0)]), -2).astype(np.float32)
            all_s, all_i, all_d = np.c_[sims[live], s], np.c_[ids[live], near], np.c_[done[live], ~new]
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            r = np.arange(len(live))[:, None]
            sims[live], ids[live], done[live] = all_s[r, top], all_i[r, top], all_d[r, top]
        out = []
        for i in rows:
            order = np.argsort(-sims[i], kind="stable")
            out.append(ids[i, order[ids[i, order] >= 0]])
        return out


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_points: int = SHARD_POINTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row for which `is_query` (over vec_id) holds."""
    rows = usable(embeddings, id_col, vec_col).distinct()
    # a point is a distinct vector with its k + 1 smallest ids, which suffice; the limit is taken before the shuffle too
    first = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = written(points.withColumn("dim", F.size("v")), "points")
    shards = {r.dim: -(-r.n // shard_points) for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not shards:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = F.element_at(F.create_map(*[F.lit(x) for d, n in shards.items() for x in (d, n)]), F.col("dim"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[x[0] for x in pdf["ids"]]).sort_values("first")
        v = np.array(pdf["v"].tolist())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "graph": [pickle.dumps((Graph(v), _scaled(v), [list(map(int, x)) for x in pdf["ids"]]), 5)]})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), count).cast("int"))
    graphs = written(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary"), "graphs")
    asked = rows.where(is_query).select("vec_id", "v", F.size("v").alias("dim"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    homes = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, queries: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(home):
            graph, v, ids = pickle.loads(home["graph"].iloc[0])  # noqa: S301  written by build
            q = _scaled(np.array(queries["v"].tolist()))
            hits = itertools.chain.from_iterable(graph.search(q[s : s + AT_ONCE], k + 1) for s in range(0, len(q), AT_ONCE))
            for own, x, found in zip(queries["vec_id"], q, hits, strict=True):
                near = v[found]
                scores = (near * x).sum(1) / (np.sqrt((near * near).sum(1)) * np.sqrt((x * x).sum()))
                one = sorted((-float(s), i) for s, p in zip(scores, found, strict=True) for i in ids[p] if i != own)
                out += [(int(own), i, -s) for s, i in one[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


