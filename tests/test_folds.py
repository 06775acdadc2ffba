"""Folds as streams and as batches: equal rows, restarts, state that goes, and the tracker's parts against plain loops."""

import math
import random
import tempfile
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidegauge.streaming import folds

T0 = datetime(2024, 1, 1)


def feed(spark, df, fn, parts=3, stops=1):
    """The rows fed as files in order of time, with the query stopped and started again in the middle."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.orderBy("ts").collect()
    for k in range(parts):
        spark.createDataFrame(rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], df.schema).coalesce(1).write.parquet(f"{folder}/all/{k}")
    for k in range(parts):
        spark.read.parquet(f"{folder}/all/{k}").coalesce(1).write.parquet(f"{folder}/in/{k}")
        if k == 0 or k == parts - 1 or stops > 1:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withWatermark("ts", "1 minute")
            q = fn(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q


def same(a, b):
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else tuple(round(y, 9) for y in x) if isinstance(x, list) else x for x in r)
    return sorted(map(str, map(key, a))) == sorted(map(str, map(key, b)))


def swinging(spark, n=90):
    rng = random.Random(5)
    rows = []
    for s in ("a", "b"):
        for i in range(n):
            w = 0.7 if i < n // 2 or s == "b" else 1.9
            rows.append((s, T0 + timedelta(minutes=i), [math.cos(w * i) + rng.gauss(0, 0.01), math.sin(w * i) + rng.gauss(0, 0.01)], rng.gauss(0.001, 0.01)))
    return spark.createDataFrame(rows, "s string, ts timestamp, x array<double>, r double")


def test_tracker_stream_equals_batch_over_a_restart(spark):
    df = swinging(spark, 60)
    fn = lambda d: folds.reharmonize(d, "s", "ts", "x", "r", idle=3600.0, draws=6, widths=(10, 20, 30))
    batch = fn(df).collect()
    got, _ = feed(spark, df, fn)
    got = got.select(*fn(df).columns).collect()
    assert len(batch) == 120 and same(got, batch)
    assert any(r.regime >= 0 for r in batch) and {r.event for r in batch} >= {"enter"}


def test_idle_state_goes(spark):
    rows = [("a", T0 + timedelta(minutes=i), 0.5, i == 0) for i in range(5)] + [("a", T0 + timedelta(hours=9, minutes=i), 0.25, i == 0) for i in range(5)] + [("b", T0 + timedelta(hours=5, minutes=i), 1.0, i == 0) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, r double, e boolean")
    fn = lambda d: folds.fold(d, "s", "ts", folds.ProfitWindows("r", "e", 2), idle=3600.0)
    got, q = feed(spark, df, fn, parts=3)
    assert same(got.select(*fn(df).columns).collect(), fn(df).collect())
    late = {(r.s, r.ts): r.cumulative for r in got.collect()}
    assert late["a", T0 + timedelta(hours=9, minutes=4)] == 1.0 and late["a", T0 + timedelta(minutes=4)] == 2.0
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert held[-1] <= 2 * 3  # the keys that are still awaited, with their timers; b has gone


def test_regimes_and_their_energy(spark):
    rows = [("s", T0 + timedelta(minutes=i), [1.0, 0.0] if i < 20 or i >= 40 else [0.0, 3.0], float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, x array<double>, e double")
    got = folds.fold(df, "s", "ts", folds.Regimes("x", "e")).orderBy("ts").collect()
    assert [(i, r.regime, r.event) for i, r in enumerate(got) if r.event] == [(4, 0, "enter"), (22, 1, "switch"), (42, 0, "switch")]
    assert got[3].regime == -1 and got[4].energy_std == 0.0 and got[22].magnitude == 1.0
    assert math.isclose(got[19].energy_mean, np.mean([i % 4 for i in range(20)])) and math.isclose(got[19].energy_std, np.std([i % 4 for i in range(20)], ddof=1))
    assert math.isclose(got[39].energy_std, np.std([i % 4 for i in range(20, 40)], ddof=1)) and got[39].confidence == 1.0


def test_filter_finds_the_backbone_and_holds_beta(spark):
    rng = random.Random(1)
    rows = [("s", T0 + timedelta(minutes=i), math.sqrt(2.0 + 0.75 * 0.8 * a * a), a, True) for i in range(400) for a in [rng.uniform(0.1, 3.0)]]
    rows += [("flat", T0 + timedelta(minutes=i), 1.5, 1.0, True) for i in range(50)] + [("off", T0, 9.0, 1.0, False), ("off", T0 + timedelta(minutes=1), None, 1.0, True)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, f double, a double, on boolean")
    got = folds.fold(df, "s", "ts", folds.BackboneFilter("f", "a", "on"))
    last = {r.s: r for r in got.groupBy("s").agg(F.max_by(F.struct(*got.columns), "ts").alias("r")).select("r.*").collect()}
    assert abs(last["s"].alpha - 2.0) < 0.1 and abs(last["s"].beta - 0.8) < 0.05 and math.isclose(sum(last["s"].chances), 1.0)
    flat = got.where("s = 'flat'").orderBy("ts").collect()
    assert flat[1].beta == flat[-1].beta and flat[-1].alpha != flat[1].alpha
    assert (last["off"].alpha, last["off"].beta, last["off"].character) == (1.0, 0.1, "mean_rev")


def test_spectra_find_the_swing(spark):
    got = folds.fold(swinging(spark).select("s", "ts", "x"), "s", "ts", folds.Spectra("x", (20, 40), draws=10)).orderBy("ts").where("s = 'b'").collect()
    assert got[1].spectra is None and len(got[-1].spectra) == 2 * 5 * 5
    modes = np.array(got[-1].spectra).reshape(2, 5, 5)
    assert (np.abs(modes[:, :, 0] - math.sin(0.7)) < 0.05).any(1).all() and (modes[:, :, 3] >= 0).all() and (modes[:, :, 3] <= 1).all()


def test_ticks_shocks_and_moments_stream_equal_batch(spark):
    rng = random.Random(9)
    rows = [("k%d" % (i % 3), T0 + timedelta(minutes=i + 500 * (i > 40)), float(rng.choice([1, 2, 5])), [rng.gauss(0, 1), rng.gauss(2, 1)]) for i in range(80)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, p double, v array<double>")
    for f in (folds.Ticks("p"), folds.Moments("v"), folds.Shocks("p", "p", 3.0)):
        fn = lambda d, f=f: folds.fold(d, "s", "ts", f, idle=7200.0)
        got, _ = feed(spark, df, fn, stops=2)
        assert same(got.select(*fn(df).columns).collect(), fn(df).collect())


def test_moments_equal_a_loop(spark):
    from tidegauge.operators.statistics import running_moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)) + np.arange(700)[:, None] / 100
    df = spark.createDataFrame([("a", i, x[i].tolist()) for i in range(700)] + [("b", 0, [1.0, 2.0, 3.0])], "s string, i int, v array<double>")
    got = {r.s: r for r in running_moments(df, "s", "i", "v").collect()}
    m, cov = x[0], np.zeros((3, 3))
    for row in x:
        m = 0.95 * m + 0.05 * row
        cov = 0.95 * cov + 0.05 * np.outer(row - m, row - m)
    assert np.allclose(got["a"].mean, m) and np.allclose(np.reshape(got["a"].cov, (3, 3)), cov)
    assert got["b"].mean == [1.0, 2.0, 3.0] and set(got["b"].cov) == {0.0}
    last = folds.fold(df.withColumn("ts", F.col("i")), "s", "ts", folds.Moments("v")).where("s = 'a' and i = 699").first()
    assert np.allclose(last.mean, m) and np.allclose(np.reshape(last.cov, (3, 3)), cov)


def test_windows_tell_a_drifting_system_from_a_steady_one(spark):
    from tidegauge.operators import statistics as st

    rows = []
    for name, speed in (("steady", 0.0), ("drifting", 0.02)):
        angle = 0.0
        for i in range(240):
            angle += 0.4 + speed * i / 10
            r = 1.0 if name == "steady" else math.exp(-0.0004 * i * i % 3)
            rows.append((name, i, [r * math.cos(angle), r * math.sin(angle)]))
    df = spark.createDataFrame([*rows, ("short", 0, [1.0, 2.0])] + [("flat", i, [1.0, 1.0]) for i in range(80)], "s string, i int, x array<double>")
    w = st.windowed_edmd(df, "s", "i", "x", 40)
    got = {r.s: r for r in st.reduce_windows(w, "s").collect()}
    by = {r.s: r for r in w.groupBy("s").agg(F.avg("drift").alias("drift"), F.avg("trust").alias("trust"), F.count("*").alias("n"), F.max(F.array_max(F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"])))).alias("top")).collect()}
    assert by["steady"].n == 21 and "short" not in by and by["steady"].drift < 1e-3 < by["drifting"].drift and by["drifting"].top <= 1.01 + 1e-9
    assert got["steady"].error < 1e-6 < got["drifting"].error and got["steady"].rejected == 0 and (got["flat"].rejected, got["flat"].windows, got["flat"].kept, got["flat"].energy) == (5, 0, None, None)
    phases = sorted(abs(math.atan2(b, a)) for a, b in zip(got["steady"].re, got["steady"].im))
    assert got["steady"].kept in (2, 3) and abs(phases[-1] - 0.4) < 1e-3 and got["steady"].energy >= 0.9


def test_rows_of_a_window_are_folded_in_many_tasks(spark):
    from pyspark.sql import Window

    rows = spark.range(400).select((F.col("id") % 40).alias("k"), "id", (F.col("id") + 1.0).alias("x"))
    before = F.coalesce(F.lag("x").over(Window.partitionBy("k").orderBy("id")), F.lit(1.0))
    told = folds.fold(rows.withColumn("y", F.col("x") + before), "k", "id", folds.Ticks("y"))
    assert told.select(F.spark_partition_id().alias("p")).distinct().count() > 1
