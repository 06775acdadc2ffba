"""Nearest entries on a line and in space against plain loops, with clumped and repeated places."""

import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidegauge.functions import calendar as cal
from tidegauge.operators import calendar as cal_ops
from tidegauge.operators import joins
from tidegauge.operators.nearest import beside, nearest_in_space


def test_beside(spark):
    rng = random.Random(1)
    entries = {(g, x): f"e{g}{x}" for g in ("a", "b", None) for x in rng.sample(range(500), 30)}
    asked = [(i, rng.choice(["a", "b", "a", None, "none"]), rng.choice([7, rng.randrange(-20, 520)])) for i in range(600)]
    q = spark.createDataFrame(asked, "q int, g string, x int").withColumn("entry", F.lit(3))
    e = spark.createDataFrame([(*k, v) for k, v in entries.items()], "g string, x int, name string").select("g", "x", F.struct("x", "name").alias("entry"))
    got = beside(q, e, ["g"], "x").collect()
    assert len(got) == len(asked)
    for r in got:
        own = sorted(x for g, x in entries if g == r.g)
        before, after = [x for x in own if x <= r.x], [x for x in own if x > r.x]
        assert (r.before.x if r.before else None) == (before[-1] if before else None)
        assert (r.after.x if r.after else None) == (after[0] if after else None)
    assert all(r.before is None and r.after is None for r in beside(q, e.limit(0), ["g"], "x").collect())


def test_any_number_of_events(spark):
    start, rng = date(1600, 1, 1), random.Random(2)
    events = sorted(rng.sample(range(150_000), 120_000))
    dates = spark.createDataFrame([(start + timedelta(days=rng.randrange(-500, 150_500)),) for _ in range(200)], "d date")
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in events[:3]])).alias("k")).unionByName(spark.createDataFrame([(x,) for x in events[3:]], "k int"))
    listed = listed.select(F.lit("fed").alias("kind"), F.date_add(F.lit(start), F.col("k").cast("int")).alias("d"), F.col("k").alias("ord"))
    got = cal_ops.nearest_event_phase(dates, listed, "fed").collect()
    on = {start + timedelta(days=x): x for x in events}

    def day(d):
        n = (d - date(1970, 1, 5)).days
        return 5 * (n // 7) + min(n % 7 + 1, 5)

    for r in got[:60]:
        near = [(abs(day(e) - day(r.d)), k, day(e) - day(r.d)) for i in range(-700, 701) if (e := r.d + timedelta(days=i)) in on for k in [on[e]]]
        assert math.isclose(r.amplitude, math.exp(-min(near)[0] / cal.HALFLIVES[cal.CHANNELS.index("fed")]))


def test_recognised_entries(spark):
    rng = random.Random(3)
    atlas = [(f"n{i}", rng.choice(["a", "b", None]), float(rng.randrange(0, 60))) for i in range(40)]
    asked = [(i, rng.choice(["a", "b", "c", None]), float(rng.randrange(-5, 90)) / 2) for i in range(150)]
    got = {r.q: r for r in joins.recognize(spark.createDataFrame(asked, "q int, domain string, w double"), spark.createDataFrame(atlas, "name string, domain string, w double"), 3.0).collect()}
    for q, d, w in asked:
        own = [(abs(w - v), n) for n, k, v in atlas if d is not None and k == d] or [(abs(w - v), n) for n, _, v in atlas]
        far, name = min(own)
        assert ((got[q].name, got[q].distance) if q in got else None) == ((name, far) if far < 3.0 else None)


def test_nearest_in_space(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [0.5 + rng.random() * 1e-7 for _ in range(3)]) for i in range(400)]  # a clump
    rows += [(2000 + i, [0.25, 0.25, 0.25]) for i in range(300)]  # one place
    rows += [(3000 + i, [i * 10.0, 0.0, -1.0]) for i in range(12)] + [(4000, [1e6, 0.0, 0.0])]
    odd = [(5000, [None, 0.0, 0.0]), (5001, [float("nan"), 0.0, 0.0]), (5002, [float("inf"), 0.0, 0.0])]
    memory = spark.createDataFrame([(i, *k) for i, k in rows + odd], "id long, a double, b double, c double").withColumn("cell", F.lit("x")).withColumn("bound", F.lit(1))
    asked = [(i, k) for i, k in rows if i % 37 == 0] + [(90_000, [-5.0, 7.0, 0.1]), (90_001, [0.25, 0.25, 0.25 + 1e-9]), (90_002, [2e6, 3.0, 0.0]), (90_003, [0.5, 0.5, 0.5])]
    queries = spark.createDataFrame([(i, *k) for i, k in asked] + [(91_000, None, 0.0, 0.0)], "q long, a double, b double, c double")
    for n, most, levels in ((7, 16, 12), (1, 4, 3), (400, 64, 16), (5000, 64, 5)):
        got = {}
        for r in nearest_in_space(queries, memory, n, ["a", "b", "c"], most, levels).collect():
            got.setdefault(r.q, []).append((r["rank"], r.id, r.distance, r["cell"]))
        assert set(got) == {i for i, _ in asked}
        for q, p in asked:
            want = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(k, p, strict=True))), i) for i, k in rows)[:n]
            assert [(g[0], g[1]) for g in sorted(got[q])] == [(r + 1, i) for r, (_, i) in enumerate(want)]
    assert nearest_in_space(queries, memory.limit(0), 3, ["a", "b", "c"]).count() == 0


def test_no_pair_of_all_in_the_plan(spark):
    df = spark.range(50).select(F.col("id"), *[(F.rand(i)).alias(c) for i, c in enumerate("abc")])
    plan = nearest_in_space(df.withColumnRenamed("id", "q"), df, 3, ["a", "b", "c"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
