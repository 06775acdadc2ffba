import json
import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.streaming import states


def _run(spark, df, stream_fn, schema):
    """The batch rows fed as several files to a stream, in order of time; what the stream gives."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.orderBy("ts").collect()
    for k in range(3):
        part = rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = "t" + folder[-6:].replace("-", "_")
    q = stream_fn(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _series(spark, n=60):
    random.seed(3)
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([("k%d" % (i % 3), t0 + timedelta(minutes=i), float(random.choice([0, 1, 2, 5]))) for i in range(n)], "symbol string, ts timestamp, price double")


def test_tick_state_stream_equals_batch(spark):
    df = _series(spark)
    batch = {tuple(r) for r in states.tick_state(df).collect()}
    assert {tuple(r) for r in _run(spark, df, states.tick_state, df.schema).collect()} == batch


def test_regimes_stream_equals_batch(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("s", t0 + timedelta(minutes=i), [1.0, 0.0] if i < 20 or i >= 40 else [0.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, x array<double>")
    fn = lambda d: states.regime_events(d, "s", "ts", "x")
    batch = sorted(tuple(r) for r in fn(df).collect())
    assert sorted(tuple(r) for r in _run(spark, df, fn, df.schema).collect()) == batch
    assert [(r[2], r[3]) for r in batch if r[3]] == [(0, "enter"), (1, "switch"), (0, "switch")]


def test_reliability_and_filter_streams_equal_batches(spark):
    df = _series(spark).withColumn("p", F.lit(1.0))
    fn = lambda d: states.reliability(d, "symbol", "ts", "p", "price").select("symbol", "ts", F.round("trust", 9).alias("trust"))
    assert {tuple(r) for r in _run(spark, df, fn, df.schema).collect()} == {tuple(r) for r in fn(df).collect()}
    fn = lambda d: states.duffing_filter(d, "symbol", "ts", "price").select("symbol", "ts", F.round("alpha", 9).alias("a"), "class")
    assert {tuple(r) for r in _run(spark, df, fn, df.schema).collect()} == {tuple(r) for r in fn(df).collect()}


def test_books_and_quotes(spark):
    book = {"channel": "l2_data", "events": [{"product_id": "A", "updates": [{"side": "bid", "qty": "3"}, {"side": "offer", "qty": "1"}]}, {"product_id": "B", "updates": []}]}
    lines = spark.createDataFrame([(json.dumps(book),), (json.dumps({"channel": "other"}),), ("{bad",), ('{"id": "x", "price": 2.5}',)], "value string")
    assert [(r.product_id, r.imbalance) for r in states.book_imbalance(states.parse_l2(lines)).collect()] == [("A", 0.5)]
    assert [tuple(r) for r in states.parse_quotes(lines).collect()] == [("x", 2.5)]


def test_health_and_seen_urls(spark):
    df = _series(spark)
    health = states.feed_health(df, "ts")
    r = states.feed_warnings(health, F.to_timestamp(F.lit("2024-01-02")), 60.0).first()
    assert r.ticks == 60 and r.warnings == ["stale"]
    urls = spark.createDataFrame([("http://A.com/x?utm_q=1", datetime(2024, 1, 1)), ("http://a.com/x", datetime(2024, 1, 2))], "url string, ts timestamp")
    assert states.dedup_urls(urls, "url", "ts").count() == 1
