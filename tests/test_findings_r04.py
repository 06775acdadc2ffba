"""Findings of the fourth review, on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import blocks, joins, profiles
from tidegauge.streaming import folds


def test_rounded_is_round_of_spark(spark):
    """halves as they are written, halves that a product with a power of ten makes or hides, and odd values."""
    rng = random.Random(11)
    x = [0.0000005, 0.0000015, 1.0000005, 0.1234565, 2.5e-7, 1.005, 0.285, 8.5e-6, -0.0000005, -1e-9, -0.0, 0.0, 1e15 + 0.3, 123456789.1234565, 3e22, math.inf, -math.inf, math.nan]
    x += [rng.randrange(10**7) / 1e6 + 5e-7 for _ in range(500)] + [rng.uniform(-2, 2) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(x)], "i int, x double").orderBy("i")
    for digits in (6, 2):
        want = [r.y for r in df.select(F.round("x", digits).alias("y")).collect()]
        assert [repr(float(y)) for y in blocks.rounded(np.array(x), digits)] == [repr(y + 0.0) for y in want]


def test_tiles_meet_every_pair_in_bounded_pieces():
    for n, m, same in ((70, 90, False), (80, 80, True), (1, 500, False), (0, 5, False)):
        met = np.zeros((n, m), dtype=int)
        for some, first in blocks.tiles(n, m, same, 300):
            assert (some.stop - some.start) * (m - first) <= 300 or some.stop - some.start == 1
            met[some, first:] += 1
        assert met.max(initial=0) <= 1 and (not same or np.triu(met).sum() == n * (n + 1) // 2) and (same or met.sum() == n * m)


def test_rows_are_added_in_order():
    rng = np.random.default_rng(14)
    for shape in ((1, 100), (2, 100), (50, 9), (3, 1)):
        x, want = rng.normal(size=shape), np.zeros(shape[0])
        for part in x.T:
            want += part
        assert blocks.added(x).tolist() == want.tolist()


def test_spectrum_pairs_are_rounded_where_they_are_made(spark):
    """no decimal is made for each pair, keys may be words, and lists of one or of several lengths are met."""
    rng = random.Random(12)
    for sizes in ((4, 5), (1, 6)):
        x = {f"k{i}": sorted(rng.uniform(0, 1) for _ in range(rng.randrange(*sizes))) for i in range(60)}
        df = spark.createDataFrame(list(x.items()), "k string, s array<double>")
        got = joins.spectrum_pairs(df, "k", "s", digits=6)
        assert "round(" not in got._jdf.queryExecution().toString()
        found = {(r.a, r.b): r.distance for r in got.collect()}
        plain = {(r.a, r.b): r.distance for r in joins.spectrum_pairs(df, "k", "s").select("a", "b", F.round("distance", 6).alias("distance")).collect()}
        assert found == plain and len(found) == 60 * 59 // 2 and all(a < b for a, b in found)


def test_equivalent_pairs_of_any_size_are_rounded_where_they_are_made(spark):
    """F1: 16 bits and single precision only leave out what they can tell; large parts, single ones and long lists are met
    in full."""
    rng = np.random.default_rng(13)
    base = rng.uniform(0, 1, size=(40, 70))
    near = np.concatenate([base, base + rng.normal(size=base.shape) * 0.002, base[:10] + 0.004])
    for kind, x, limit in (("float", near, 0.03), ("double", near, 0.03), ("float", near, 0.003), ("double", near + 1e6, 0.003), ("double", near[:, :1], 0.003)):
        x = x.astype(np.float32).astype(float) if kind == "float" else x
        df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], f"k string, s array<{kind}>")
        got = profiles.equivalent_pairs(df, "k", "s", limit, digits=6)
        assert "round(" not in got._jdf.queryExecution().toString()
        rows = got.collect()
        s = -np.sort(-np.abs(x), axis=1)
        far = np.array([np.add.accumulate(np.abs(s - t), axis=1)[:, -1] for t in s]) / x.shape[1]
        want = {(f"{a:03d}", f"{b:03d}"): round(float(far[a, b]), 6) for a in range(len(x)) for b in range(a + 1, len(x)) if far[a, b] < limit}
        assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want) > 30


def spectrum(f, rows, n):
    """One window's spectrum, replicate by replicate."""
    psi = f.basis(rows)
    a, b = psi[:-1], psi[1:]
    drawn = np.random.default_rng([f.seed, n, len(rows)]).multinomial(len(a), np.full(len(a), 1.0 / len(a)), size=f.draws)

    def values(w):
        e = np.linalg.eigvals(np.linalg.pinv((a.T * w) @ a, rcond=1e-10) @ ((a.T * w) @ b))
        return e[np.lexsort((e.imag, e.real, -np.round(np.abs(e), 12)))][: f.modes]

    base = values(np.ones(len(a)))
    freq = np.abs(base.imag)
    order, found, out = np.argsort(freq, kind="stable"), [[] for _ in base], []
    for w in drawn:
        for k, x in zip(order, np.sort(np.abs(values(w.astype(float)).imag)), strict=True):
            if abs(x - freq[k]) <= 0.2 * max(freq[k], 0.1):
                found[k].append(x)
    for k in range(f.modes):
        if k >= len(base):
            out += [math.nan] * 5
        else:
            x = found[k]
            out += [np.median(x) if x else freq[k], -base[k].real, abs(base[k]), len(x) / f.draws, np.var(x) if x else math.inf]
    return out


@pytest.mark.parametrize("d", [1, 2, 3])
def test_spectra_of_many_windows_equal_a_loop(d):
    """windows are solved together, those of too few different pairs too, without a pseudoinverse where none is needed."""
    rng = np.random.default_rng(d)
    f = folds.Spectra("x", (8, 20, 30), draws=12, modes=5)
    swing = np.cos(0.7 * np.arange(40)[:, None] + np.arange(d)) + rng.normal(size=(40, d)) * 0.05
    # of repeated rows a step's zeros may be fourfold, so that rounding moves them by its fourth root, whoever solves
    for rows, near in ((rng.normal(size=(40, d)), 1e-8), (np.round(rng.normal(size=(40, d))), 2e-3), (np.ones((40, d)), 1e-8), (swing, 1e-8)):
        state, last = f.fresh(), None
        for n in range(1, 41):
            got = f.step(state, rows[n - 1])[0]
            if n >= 3 and (last is None or n % 5 == 0):
                last = [x for w in f.widths for x in spectrum(f, rows[max(0, n - w) : n], n)]
            assert (got is None) == (last is None) and (got is None or np.allclose(got, last, rtol=1e-6, atol=near, equal_nan=True))


@pytest.mark.parametrize("size", [7, 10000])
def test_tracker_reads_a_table_once(spark, size):
    """one pass that deals rows once gives what the chained folds give, whatever the batches, for series that rest, that
    are short, that have no name or null returns."""
    rng = random.Random(21)
    rows = []
    for k, n in (("a", 75), ("b", 52), ("c", 2), (None, 20), ("d", 1)):
        for i in range(n):
            w = 0.7 if i < 35 else 1.9
            rows.append((k, float(i + 5000 * (k == "b" and i > 40)), [math.cos(w * i) + rng.gauss(0, 0.02), math.sin(w * i) + rng.gauss(0, 0.02)], None if i % 11 == 5 else rng.gauss(0.0, 0.01)))
    df = spark.createDataFrame(rows, "s string, at double, x array<double>, r double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = folds.reharmonize(df, "s", "at", "x", "r", idle=100.0, widths=(10, 20, 30), draws=6)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and plan.count("Exchange") == 1
        mine = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chain = folds.chained(df, "s", "at", "x", "r", 100.0, (10, 20, 30), 5, 6, 0.05)
    assert got.schema.simpleString() == chain.schema.simpleString()
    key = lambda r: (r.s or "", r.at)
    want = chain.collect()
    assert len(mine) == len(want) == 150 and {"enter", "switch"} <= {r.event for r in mine}
    for r, w in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(r, w, strict=True):
            assert x == y or np.allclose(np.array(x, float), np.array(y, float), rtol=1e-9, atol=1e-9, equal_nan=True), (r, w)
