"""Locks of mode pairs, generic page fields, and the store that is refreshed every n rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.functions import text as tx
from tidegauge.operators import joins
from tidegauge.streaming import states


def test_mode_locks_and_state(spark):
    a = [(k, i, 0.3 + 0.17 * i + 0.01 * k, 0.9, 0.1) for k in range(3) for i in range(20)] + [(1, 30, 9.0, 0.5, 0.1), (5, 0, 1.0, 0.9, 0.1)]
    b = [(k, i, 0.2 + 0.11 * i, 0.9, 2.0 if i == 0 else 0.1) for k in range(3) for i in range(4)]
    cols = "k int, idx int, frequency double, stability double, variance double"
    locks = joins.mode_locks(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), "k", 0.05, 7)
    got = {(r.k, r.ia, r.ib): (r.lock, r.p, r.q, r.off) for r in locks.collect()}
    want = {}
    for k in range(3):
        x = [m for m in a if m[0] == k and m[3] >= 0.6 and m[4] < 1]
        y = [m for m in b if m[0] == k and m[3] >= 0.6 and m[4] < 1]
        for p, q in [(m, n) for m in x for n in y][:7]:
            want[k, p[1], q[1]] = math.exp(-min(abs(p[2] - u / v * q[2]) for u, v in spectral.rationals(8)) / 0.05)
    assert set(got) == set(want) and all(abs(got[p][0] - w) < 1e-12 for p, w in want.items())
    assert all(r[2] <= 8 and math.gcd(r[1], r[2]) == 1 and r[3] < 0.5 for r in got.values())
    state = {r.k: r for r in joins.coherence_state(locks, spark.createDataFrame([(0, 2.0, 1.5), (9, 1.0, 3.0)], "k int, first double, second double"), "k").collect()}
    mine = {p: w for p, w in want.items() if p[0] == 0}
    assert set(state) == {0, 9} and abs(state[0].coherence - sum(mine.values()) / len(mine)) < 1e-12 and abs(state[0].dominant.lock - max(mine.values())) < 1e-12
    assert state[0].entropy_drop == 0.5 and state[9].coherence == 0.0 and state[9].dominant is None


def test_generic_fields(spark):
    html = ["<html><title> A &amp; B </title><body class='x'><h1>H</h1><script>no</script><p>one<b>two</b> &lt;three</p><!-- c --></body>", "<h1>Only <i>this</i></h1>", "<title></title><h1>H</h1><body>open", "", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, html string")
    got = [(r.headline, r.body, r.n_words) for r in df.select("i", *[c.alias(k) for k, c in tx.article_fields(F.col("html")).items()]).orderBy("i").collect()]
    assert got == [("A & B", "H one two <three", 4), ("Only this", "", 0), ("", "open", 1), ("", "", 0), ("", "", 0)]
    own = df.where("i = 0").select(tx.article_fields(F.col("html"), F.lit("mine"), F.lit(""))["headline"].alias("h"), tx.article_fields(F.col("html"), None, F.lit("b b"))["n_words"].alias("n")).first()
    assert (own.h, own.n) == ("mine", 2)


def test_a_retried_batch_is_in_the_store_once(spark, tmp_path):
    for i in range(5):
        spark.range(i * 4, i * 4 + 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, failures = [], [1]

    def refresh(rows):
        if failures:
            failures.pop()
            raise RuntimeError("the first refresh fails")
        seen.append((rows.columns, sorted(r.id for r in rows.collect())))

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = states.consolidate_every(stream, 8, refresh, str(tmp_path / "store"), str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="refresh"):
        run()
    run()
    assert [c for c, _ in seen] == [["id"], ["id"]] and [len(i) for _, i in seen] == [8, 16] and all(len(set(i)) == len(i) for _, i in seen)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == list(range(20))
