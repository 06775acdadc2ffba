"""Numbers and running sums against plain loops."""

import itertools

from pyspark.sql import functions as F

from tidegauge.operators import ordering, relations


def test_numbered_and_running_sums(spark):
    rows = [(k, v, n) for k, v, n in itertools.product(["a", None, ""], [3, None, 1, 1, 2], [5, None])] + [("hot", 7, 1)] * 500
    df = spark.createDataFrame(rows, "k string, v int, n int")
    got = ordering.numbered(df, ["k"], ["v"]).collect()
    assert len(got) == len(rows)
    for key in ("a", None, "", "hot"):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own))) and {r.group_rows for r in own} == {len(own)}
        values = [-1 if r.v is None else r.v for r in own]
        assert values == sorted(values)
    got = ordering.running_sums(df, ["k"], ["v", "n"], {"n": "s", "v": "t"}).collect()
    assert len(got) == len(rows)
    for key in ("a", None, "", "hot"):
        own = sorted((r for r in got if r.k == key), key=lambda r: (r.v is not None, r.v, r.n is not None, r.n, r.s))
        assert sorted(r.s for r in own) == list(itertools.accumulate(r.n or 0 for r in own))
        assert sorted(r.t for r in own) == list(itertools.accumulate(r.v or 0 for r in own))
    assert ordering.numbered(df.limit(0), [], ["v"]).count() == 0 and ordering.running_sums(df.limit(0), ["k"], ["v"], {"n": "s"}).count() == 0


def test_assigned_slots_of_a_million(spark):
    n = 1_000_000
    lib = spark.range(0, n, 1, 16).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("canonical"), F.array_repeat(F.lit("d"), (F.col("id") % 3 + 1).cast("int")).alias("domains"), (F.col("id") % 7 == 0).alias("f"))
    got = relations.assign_dims(lib, "canonical", F.col("f"), F.when(F.col("f"), 5).otherwise(1)).select(F.col("canonical").cast("int").alias("i"), "first_dim").toPandas()
    want, at = {}, 0
    for i in sorted(range(n), key=lambda i: (i % 7 != 0, -(i % 3 + 1), i)):
        want[i] = at
        at += 5 if i % 7 == 0 else 1
    assert dict(zip(got.i, got.first_dim, strict=True)) == want
