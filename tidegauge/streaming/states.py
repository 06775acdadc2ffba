"""Stateful operators over event streams, each with its batch twin on the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.functions.market import micros

BOOK = "channel string, events array<struct<product_id:string,updates:array<struct<side:string,qty:string>>>>"


def parse_quotes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, price) of JSON quotes; malformed ones are dropped. Works on batches and streams."""
    q = F.from_json(F.col(column).cast("string"), "id string, price double")
    return lines.select(q.alias("q")).where("q.id is not null and q.price is not null").select("q.*")


def parse_l2(lines: DataFrame, column: str = "value") -> DataFrame:
    """(product_id, updates) of JSON book messages of the level-2 channel."""
    m = F.from_json(F.col(column).cast("string"), BOOK)
    return lines.select(m.alias("m")).where("m.channel = 'l2_data'").select(F.inline("m.events"))


def book_imbalance(books: DataFrame) -> DataFrame:
    """(bid - ask) / (bid + ask) of each book event with any quantity."""
    total = lambda side: F.aggregate(F.filter("updates", lambda u: u["side"] == side), F.lit(0.0), lambda s, u: s + F.coalesce(u["qty"].try_cast("double"), F.lit(0.0)))
    sides = books.withColumn("bid", total("bid")).withColumn("ask", total("offer"))
    return sides.where("bid + ask > 0").withColumn("imbalance", (F.col("bid") - F.col("ask")) / (F.col("bid") + F.col("ask"))).drop("updates")


def _stateful(stream: DataFrame, key: str, fn: Callable, out: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.NoTimeout)


def _in_order(df: DataFrame, key: str, order: str, fn: Callable, out: str) -> DataFrame:
    """`fn(key, rows, state or None)` gives rows and the state for the key's next rows; series are sorted by Spark and read
    in batches, so that none is held whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = (), None
        for pdf in frames:
            for name, rows in pdf.groupby(key, sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if name != now:
                    now, state = name, None
                told, state = fn(name, rows, state)
                yield told

    # As many tasks as the session has, however few the bytes. Dealt by a hash of the key: a repartition by the key itself is
    # left out where rows come from a window over that key, and its partitions are then merged by their bytes.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(key)).sortWithinPartitions(key, order).mapInPandas(run, out)


def tick_state(stream: DataFrame, key: str = "symbol", order: str = "ts", price: str = "price", idle: float | None = None) -> DataFrame:
    """Per tick: the last price and its momentum over the tick before; a zero price changes nothing. A batch input gives
    the same rows by windows. A symbol that is idle for so many seconds starts afresh, and a stream lets its state go."""
    if not stream.isStreaming and idle is None:
        before = F.lag(price).over(Window.partitionBy(key).orderBy(order))
        ticks = stream.where(F.col(price) != 0)
        return ticks.select(key, order, price, F.coalesce((F.col(price) - before) / before, F.lit(0.0)).alias("momentum"))

    from tidegauge.streaming.folds import Ticks, fold

    return fold(stream.where(F.col(price) != 0).select(key, order, price), key, order, Ticks(price), idle)


def shock_state(events: DataFrame, key: str, ts: str, impact: str, now: Column, tau_hours: float) -> DataFrame:
    """Each key's decayed sum of impacts as of a time, its largest decay, and the last event's impact. Later events and
    those at negative age count with age 0."""
    decay = F.exp(-F.greatest((micros(now) - micros(F.col(ts))) / 3.6e9, F.lit(0.0)) / tau_hours)
    return events.groupBy(key).agg(F.sum(F.col(impact) * decay).alias("shock"), F.max(decay).alias("max_decay"), F.max_by(impact, ts).alias("last_impact"))


def shock_stream(stream: DataFrame, key: str, ts: str, impact: str, tau_hours: float, idle: float | None = None) -> DataFrame:
    """Per event: the decayed level right after it. Decay is multiplicative, so a key's state is a level and a time. A key
    that is idle for so many seconds starts afresh: what has decayed for long may be let go."""
    from tidegauge.streaming.folds import Shocks, fold

    rows = stream.select(key, ts, F.col(impact).cast("double").alias(impact), (micros(F.col(ts)) / 1e6).alias("fold_seconds"))
    return fold(rows, key, ts, Shocks(impact, "fold_seconds", tau_hours), idle).select(key, ts, "level")


def reliability(df: DataFrame, key: str, order: str, predicted: str, observed: str) -> DataFrame:
    """Each source's trust, 0.95 t + 0.05 / (1 + |error|) per row from 0.5 on. As the update is linear, a batch folds it
    by the affine recurrence; a stream keeps the last value."""
    kind = df.schema[key].dataType.simpleString()
    if not df.isStreaming:
        from tidegauge.operators.windows import linear_recurrence

        gain = 1.0 / (1.0 + F.abs(F.col(predicted) - F.col(observed)))
        first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
        rows = df.withColumn("_x", F.when(first, 0.95 * 0.5 + 0.05 * gain).otherwise(gain))
        return linear_recurrence(rows, [key], order, "_x", 0.95, 0.05, "trust").drop("_x")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, trust, out = pd.concat(frames).sort_values(order), state.get[0] if state.exists else 0.5, []
        for e in (rows[predicted] - rows[observed]).abs():
            trust = 0.95 * trust + 0.05 / (1.0 + e)
            out.append(trust)
        state.update((trust,))
        yield pd.DataFrame({key: k[0], order: rows[order], "trust": out})

    return _stateful(df, key, step, f"{key} {kind}, {order} timestamp, trust double", "trust double")


def regime_events(df: DataFrame, key: str, order: str, vector: str, energy: Column | None = None, idle: float | None = None, **options) -> DataFrame:
    """(key, order, regime, event, confidence, energy_mean, energy_std, magnitude) of every row, for tables and streams; the
    energy is the vector's length unless another one is given. See `folds.Regimes`."""
    from tidegauge.streaming.folds import Regimes, fold

    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(key, order, vector, F.coalesce(length if energy is None else energy, F.lit(0.0)).alias("fold_energy"))
    return fold(rows, key, order, Regimes(vector, "fold_energy", **options), idle).drop(vector, "fold_energy")


def duffing_filter(df: DataFrame, key: str, order: str, value: str, noise: float = 1e-3, drift: float = 1e-4) -> DataFrame:
    """Per row: estimates of a series' mean reversion, cubic reaction and damping by a Kalman filter over its parameters,
    each key on its own. The regressors are the last value, its cube and its last change; rows whose regressors say
    nothing are passed over. Class: oscillating, drifting, hardening or softening by the estimates' signs."""
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {order} timestamp, alpha double, beta double, delta double, class string"

    def walk(name, rows: pd.DataFrame, theta: np.ndarray, cov: np.ndarray, last: list[float]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, list[float]]:
        rows, told = rows.sort_values(order), []
        for x in rows[value].astype(float):
            if len(last) == 2:
                h = np.array([-last[1], -(last[1] ** 3), -(last[1] - last[0])])
                if h @ h > 1e-12:
                    cov = cov + drift * np.eye(3)
                    gain = cov @ h / (h @ cov @ h + noise)
                    theta = theta + gain * ((x - 2 * last[1] + last[0]) - h @ theta)
                    cov = cov - np.outer(gain, h @ cov)
            last = [*last, x][-2:]
            a, b, d = theta
            told.append((a, b, d, "drifting" if a <= 0 else "oscillating" if abs(b) < 0.1 * a else "hardening" if b > 0 else "softening"))
        frame = pd.DataFrame(told, columns=["alpha", "beta", "delta", "class"])
        frame.insert(0, order, list(rows[order]))
        frame.insert(0, key, name)
        return frame, theta, cov, last

    def onward(name, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        frame, *after = walk(name, rows, *(state or (np.zeros(3), np.eye(3), [])))
        return frame, tuple(after)

    if not df.isStreaming:
        return _in_order(df.select(key, order, value), key, order, onward, out)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta, cov, last = (np.array(state.get[0]), np.array(state.get[1]).reshape(3, 3), list(state.get[2])) if state.exists else (np.zeros(3), np.eye(3), [])
        frame, theta, cov, last = walk(k[0], pd.concat(frames), theta, cov, last)
        state.update((theta.tolist(), cov.ravel().tolist(), last))
        yield frame

    return _stateful(df, key, step, out, "theta array<double>, cov array<double>, last array<double>")


def slice_at(df: DataFrame, key: str, ts: str, at: Column | None = None, nearest: bool = False) -> DataFrame:
    """Each key's row at a time: the latest without `at` (or up to it), or the nearest, the earlier one on ties."""
    if at is None or not nearest:
        rows = df if at is None else df.where(F.col(ts) <= at)
        return rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), ts).alias("r")).select("r.*")
    far = F.abs(micros(F.col(ts)) - micros(at))
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(far, F.col(ts))).alias("r")).select("r.*")


def feed_health(df: DataFrame, ts: str, watermark: str = "10 minutes") -> DataFrame:
    """Ticks of every minute and the last tick in it; streams get a watermark."""
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    counted = rows.groupBy(F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("ticks"), F.max(ts).alias("last_tick"))
    return counted.select(F.col("w.start").alias("minute"), "ticks", "last_tick")


def feed_warnings(health: DataFrame, now: Column, most_stale_seconds: float) -> DataFrame:
    """One row: not_running, zero_ticks or stale, as they hold."""
    seen = health.agg(F.max("last_tick").alias("last_tick"), F.coalesce(F.sum("ticks"), F.lit(0)).alias("ticks"))
    stale = (micros(now) - micros(F.col("last_tick"))) / 1e6
    names = F.array(F.when(F.col("last_tick").isNull(), "not_running"), F.when(F.col("ticks") == 0, "zero_ticks"), F.when(stale > most_stale_seconds, "stale"))
    return seen.select("last_tick", "ticks", F.filter(names, lambda x: x.isNotNull()).alias("warnings"))


def dedup_urls(df: DataFrame, url: str, ts: str, watermark: str = "1 day") -> DataFrame:
    """First sighting of each URL key; a stream forgets keys older than the watermark."""
    from tidegauge.functions.text import canonical_url, doc_key

    keyed = df.withColumn("url_key", doc_key(canonical_url(F.col(url))))
    if df.isStreaming:
        return keyed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url_key"])
    return keyed.groupBy("url_key").agg(F.min_by(F.struct(*df.columns), ts).alias("r")).select("r.*", "url_key")


def poll_articles(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON articles dropped into a folder."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").json(path)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, log: Callable[[str], None] = print):
    """Runs a callback on every micro-batch; its errors are logged and the stream goes on."""

    def safe(batch: DataFrame, epoch: int) -> None:
        try:
            fn(batch, epoch)
        except Exception as e:  # noqa: BLE001  a callback must not end the feed
            log(f"callback failed in batch {epoch}: {e}")

    return stream.writeStream.foreachBatch(safe).option("checkpointLocation", checkpoint)


def publish_snapshot(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """Overwrites one small JSON folder with the latest batch's rows as payloads."""
    return each_batch(stream, lambda batch, _: batch.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path), checkpoint).trigger(processingTime=every)


def consolidate_every(stream: DataFrame, n: int, refresh: Callable[[DataFrame], None], store: str, checkpoint: str):
    """Keeps batches in a store, one folder each, and calls `refresh` on all of it whenever another n rows have come.

    A batch that is tried again replaces its own folder, so that no row is in twice; it may call `refresh` again. How many
    rows there were after a batch is written beside the store, so that the next one counts itself only. An error ends the
    stream, which then goes on from the batch that failed."""
    kept = f"{store.rstrip('/')}-counts"

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        new = spark.read.schema(batch.schema).parquet(f"{store}/epoch={epoch}").count()
        before = spark.read.parquet(f"{kept}/{epoch - 1}").first()["total"] if epoch else 0
        spark.range(1).select(F.lit(before + new).cast("long").alias("total")).write.mode("overwrite").parquet(f"{kept}/{epoch}")
        if new and (before + new) // n > before // n:
            refresh(spark.read.parquet(store).drop("epoch"))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def record_trajectory(stream: DataFrame, path: str, checkpoint: str, every: str = "30 seconds"):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def propagate(df: DataFrame, shock: Column, regime: Column, phi: float, psi: float, gate: Column | None = None) -> DataFrame:
    """Shocks passed up two scales: dm = phi * s (times a calendar gate), dl = psi * (m + dm)."""
    dm = shock * phi * (gate if gate is not None else F.lit(1.0))
    return df.withColumn("delta_regime", dm).withColumn("delta_fundamental", (regime + dm) * psi)
