"""Skylines merged in a tree, neighbouring fractions, and directions that domains share, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import graph, learning
from tidegauge.operators import statistics as st


def test_skyline_by_tree_and_by_blocks(spark):
    rng = random.Random(8)
    pts = [(i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(6))) for i in range(600)]
    want = {i for i, a, b, c in pts if not any(x <= a and y >= b and z <= c and (x < a or y > b or z < c) for _, x, y, z in pts)}
    df = spark.createDataFrame(pts, "i int, a double, b double, c double").repartition(16)
    for most in (20_000, 30, 1):
        assert {r.i for r in st.skyline(df, "i", ["a", "c"], ["b"], fan=2, most=most).collect()} == want
    line = spark.range(300).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    assert st.skyline(line, "i", ["a", "b"], most=50).count() == 300 and st.skyline(line.limit(0), "i", ["a"]).count() == 0


def test_fractions(spark):
    rows = [(i, p, q) for i, (p, q) in enumerate((p, q) for p in range(-6, 40) for q in range(1, 23))] + [(5000, 1, 2), (5001, 2_000_000_011, 2_000_000_010), (5002, 1, 1), (5003, 3, 0)]
    got = {(r.src, r.dst) for r in graph.fraction_edges(spark.createDataFrame(rows, "node int, p long, q long")).collect()}
    sound = [r for r in rows if r[2] > 0]
    assert got == {(a, b) for a, p, q in sound for b, x, y in sound if abs(p * y - x * q) == 1 and a != b or abs(p * y - x * q) == 1}
    assert all(math.gcd(p, q) == 1 for n, p, q in rows if any(n == a for a, _ in got))


def test_planted_directions_are_found(spark):
    rng = np.random.default_rng(2)
    common, rows = np.linalg.qr(rng.normal(size=(12, 2)))[0], []
    for name in range(4):
        own = np.linalg.qr(rng.normal(size=(12, 2)))[0]
        for _ in range(200):
            rows.append((name, (common @ rng.normal(size=2) * 3 + own @ rng.normal(size=2) * 2 + rng.normal(size=12) * 0.01).tolist()))
    df = spark.createDataFrame(rows, "d int, v array<double>")
    got = learning.shared_directions(df, "d", "v", 4, 0.5).orderBy("direction").collect()
    for r in got[:2]:
        assert r.strength > 0.99 and r.least_norm > 0.99 and np.linalg.norm(common.T @ np.array(r.v)) > 0.99
    assert all(r.least_norm >= 0.5 for r in got) and all(r.strength < 0.9 for r in got[2:])
    assert learning.shared_directions(df.where("d = 0"), "d", "v", 4).count() == 0 and learning.shared_directions(df.limit(0), "d", "v", 4).count() == 0


def test_calendar_stages(spark):
    rng = np.random.default_rng(4)
    base, extra, rows, phases = np.array([[0.5, 0.1], [0.0, 0.3]]), np.array([[0.0, 0.25], [0.2, 0.0]]), [], []
    for i in range(600):
        x, on = rng.normal(size=2), i % 3 == 0
        rows.append((i, x.tolist(), (base @ x + (extra @ x if on else 0)).tolist()))
        phases += [(i, "fed", 0.0 if on else math.pi, 1.0 if on else 0.01), (i, "rare", 0.0, 1.0 if i < 3 else 0.0)]
    pairs, channels = spark.createDataFrame(rows, "k int, x array<double>, y array<double>"), spark.createDataFrame(phases, "k int, channel string, theta double, amplitude double")
    got = {r.channel: r for r in st.fit_calendar_stages(pairs, channels, "k", "x", "y", bound=5.0, ridge=1e-6).collect()}
    assert set(got) == {"base", "fed"}  # three rows are too few
    full = np.reshape(got["base"].matrix, (2, 2)) + np.reshape(got["fed"].matrix, (2, 2))
    assert np.allclose(full, base + extra, atol=0.02)
    held = {r.channel: np.reshape(r.matrix, (2, 2)) for r in st.fit_calendar_stages(pairs, channels, "k", "x", "y", bound=0.55, ridge=1e-6).collect()}
    whole = np.linalg.norm(held["base"] + np.reshape(got["fed"].matrix, (2, 2)), 2)
    assert np.allclose(held["fed"], np.reshape(got["fed"].matrix, (2, 2)) * 0.55 / whole * 0.99, atol=0.02) or np.linalg.norm(held["base"] + held["fed"], 2) <= 0.62
    assert st.fit_calendar_stages(pairs.limit(0), channels, "k", "x", "y").count() == 0
