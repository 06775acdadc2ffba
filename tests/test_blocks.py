"""Pairs and searches in blocks, against plain loops; no table of candidate pairs is joined."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import blocks, graph, joins, profiles


def plan(df):
    return df._jdf.queryExecution().toString()


def in_groups(df):
    return "FlatMapGroupsInArrow" in plan(df)


def test_every_pair_of_blocks_is_met_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") < 2900, 0).otherwise(1).alias("g"))

    def ids(left, right, same):
        i, j = left["k"].to_numpy(), right["k"].to_numpy()
        r, c = np.nonzero(i[:, None] < j[None, :] if same else np.ones((len(i), len(j)), dtype=bool))
        yield blocks.batch({}, n=[len(r)], most=[len(i)])

    got = blocks.block_pairs(rows, "k", ids, "n long, most long", ["g"], most=500).agg(F.sum("n"), F.max("most")).first()
    assert got[0] == 2900 * 2899 // 2 + 100 * 99 // 2 and got[1] < 700


def test_spectrum_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(rng.randrange(1, 5))]) for i in range(90)] + [(90, 0, None), (91, None, [1.0]), (92, 0, [None, 0.5])]
    df = spark.createDataFrame(rows, "k long, g int, s array<double>")

    def far(x, y):
        if x is None or y is None:
            return None
        a, b = (sorted(v, key=lambda e: (e is not None, e or 0.0)) for v in (x, y))
        n = max(len(a), len(b))
        return sum(abs((p or 0.0) - (q or 0.0)) for p, q in zip(a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b)), strict=True)) / n

    for bucket in ("g", None):
        got = joins.spectrum_pairs(df, "k", "s", bucket)
        assert in_groups(got)
        want = {(a, b): far(x, y) for a, g, x in rows for b, h, y in rows if a < b and (bucket is None or g is not None and g == h)}
        found = {(r.a, r.b): r.distance for r in got.collect()}
        assert set(found) == set(want) and all(d is want[p] is None or abs(d - want[p]) < 1e-12 for p, d in found.items())


def test_common_places_make_no_table_of_candidates(spark):
    rng = random.Random(4)
    sets = [(i, "d%d" % (i % 3), rng.sample(range(20), 8)) for i in range(200)]
    df = spark.createDataFrame(sets, "pattern_id long, dimension string, dims array<int>")
    want = {(a, b) for a, da, x in sets for b, db, y in sets if da < db and len(set(x) & set(y)) / math.sqrt(len(x) * len(y)) >= 0.7 - 1e-12}
    told = joins.find_universals(df, 0.7)
    assert in_groups(told)
    for got in (told, joins.find_universals(df, 0.7, dense=False)):
        rows = got.collect()
        assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_equivalent_and_parallel_vectors_meet_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 6))
    v = np.concatenate([v, v[:20] * 1.001, -v[:5]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, s array<double>")
    s = np.sort(np.abs(v), axis=1)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if np.abs(s[i] - s[j]).mean() < 0.1}
    got = profiles.equivalent_pairs(df, "id", "s", 0.1)
    assert in_groups(got) and {(r.a, r.b) for r in got.collect()} == want and want
    assert {(r.component, r.members) for r in graph.merge_redundant(df, "id", "s", 0.05).collect()} == {(i, 1 + (i < 20) + (i < 5)) for i in range(60)}


@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_by_cosine_equal_all_pairs(spark, k):
    rng = np.random.default_rng(7)
    v = [*rng.integers(-2, 3, size=(40, 3)).astype(float).tolist(), [1.0, 0.0], [0.0, 0.0, 0.0]]  # many ties
    store = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    asked = spark.createDataFrame([(str(i), x) for i, x in enumerate(v[:12])] + [("zero", [0.0] * 3)], "q string, v array<double>")
    found = joins.cosine_top_k(asked, store, k)
    assert in_groups(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.similarity))

    def unit(x):
        n = math.sqrt(sum(a * a for a in x))
        return [a / n if n else a for a in x]

    for q, x in [(str(i), x) for i, x in enumerate(v[:12])] + [("zero", [0.0] * 3)]:
        near = sorted((-sum(a * b for a, b in zip(unit(x), unit(y), strict=False)), i) for i, y in enumerate(v))[:k]
        mine = sorted(got[q])
        assert [i for _, i, _ in mine] == [i for _, i in near] and all(abs(s + n) < 1e-12 for (_, _, s), (n, _) in zip(mine, near, strict=True))
