"""Calendar queries over the order dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import calendar as cal
from tidegauge.operators import calendar as ops
from tidegauge.plans.registry import query, table

#: Two intervals of marked market stress, as an example of anchors.
ANCHORS = [(1, "asia_crisis", "1997-07-02", "1997-12-31", [0.1, 0.2, 0.3, 0.4, 0.5], 0.9), (2, "autumn_1997", "1997-10-01", "1998-10-15", [1.0, 2.0, 3.0, 1.0, 2.0], 0.7)]


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


def anchors(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ANCHORS, "ord int, name string, s string, e string, anchor array<double>, severity double")
    return rows.select("ord", "name", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"), "anchor", "severity")


def _rounded(c: str) -> F.Column:
    return F.transform(c, lambda x: F.round(x, 6))


_W = "(5 * floor(date_diff('day', DATE '1970-01-05', {0}) / 7) + least(((date_diff('day', DATE '1970-01-05', {0}) % 7) + 7) % 7 + 1, 5))"
_FRI = "(make_date({0}, {1}, 1) + ((4 - (isodow(make_date({0}, {1}, 1)) - 1) + 7) % 7)::INT + 14)"
_DAYS = "days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)"
_EVENTS = f"""
    years AS (SELECT d, year(d) + y AS yy, y FROM days, (VALUES (-1), (0), (1)) t(y)),
    events AS (
        SELECT d, 0 AS c, make_date(yy, m, 15) AS e, i * 3 + CASE y WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS ord FROM years, (VALUES (1, 0), (4, 1), (7, 2), (10, 3)) t(m, i)
        UNION ALL SELECT d, 1, make_date(yy, m, 15), (y + 1) * 20 + m FROM years, (VALUES (1), (3), (5), (6), (7), (9), (11), (12)) t(m)
        UNION ALL SELECT d, 2, {_FRI.format('yy', 'm')}, (y + 1) * 20 + m FROM years, range(1, 13) t(m)
        UNION ALL SELECT d, 3, {_FRI.format('yy', 'm')}, (y + 1) * 20 + m FROM years, (VALUES (3), (6), (9), (12)) t(m)
        UNION ALL SELECT d, 4, make_date(yy, m, k), (y + 1) * 20 + i FROM years, (VALUES (1, 1, 0), (1, 20, 1), (2, 17, 2), (5, 26, 3), (7, 4, 4), (9, 1, 5), (11, 27, 6), (12, 25, 7)) t(m, k, i)
    ),
    nearest AS (SELECT d, c, arg_min(dist, (abs(dist), ord)) AS dist FROM (SELECT d, c, ord, {_W.format('e')} - {_W.format('d')} AS dist FROM events) GROUP BY d, c),
    phased AS (
        SELECT d, c, dist, (2 * pi() * dist / p) % (2 * pi()) + CASE WHEN (2 * pi() * dist / p) % (2 * pi()) < 0 THEN 2 * pi() ELSE 0 END AS theta, exp(-abs(dist) / h) AS amp
        FROM nearest JOIN (VALUES (0, 63.0::DOUBLE, 5.0::DOUBLE), (1, 31.5, 2.0), (2, 21.0, 3.0), (3, 63.0, 3.0), (4, 252.0, 2.0)) t(c, p, h) USING (c)
    )"""


@query(f"WITH {_DAYS} SELECT d, {_FRI.format('year(d)', 'month(d)')} AS third_friday FROM days")
def h01_third_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("d", cal.third_friday(F.year("d"), F.month("d")).alias("third_friday"))


@query(f"WITH {_DAYS} SELECT d, ({_W.format('d')} - {_W.format(chr(39) + '1998-01-03' + chr(39) + '::DATE')})::BIGINT AS n FROM days")
def h02_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("d", cal.trading_days(F.to_date(F.lit("1998-01-03")), F.col("d")).alias("n"))


@query(f"WITH {_DAYS}, spans AS (SELECT date_trunc('month', d)::DATE AS m, min(d) AS lo, max(d) AS hi FROM days GROUP BY 1) SELECT m, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM spans QUALIFY true".replace(" QUALIFY true", "").replace("SELECT m, unnest", "SELECT m, d FROM (SELECT m, unnest").replace(" AS d FROM spans", " AS d FROM spans) WHERE isodow(d) < 6"))
def h03_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = days(spark, sf_dir).groupBy(F.trunc("d", "month").alias("m")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return ops.date_range(spans, "lo", "hi").select("m", "d")


@query(f"WITH {_DAYS}, {_EVENTS} SELECT d, c::INT AS channel, e AS event FROM events")
def h04_default_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("channel"), cal.default_events(F.col("d"), c).alias("events")) for i, c in enumerate(cal.CHANNELS)])
    return days(spark, sf_dir).select("d", F.inline(listed)).select("d", "channel", F.explode("events").alias("event"))


@query(f"""WITH {_DAYS}, p AS (SELECT d, c, (date_diff('day', DATE '2020-01-01', d) * 5.0::DOUBLE / 7.0::DOUBLE) AS x, per FROM days, (VALUES (0, 63.0::DOUBLE), (1, 31.5), (2, 21.0), (3, 63.0), (4, 252.0)) t(c, per)),
    q AS (SELECT d, c, ((x % per) + per) % per / per * (2 * pi()) AS theta FROM p)
    SELECT d, c::INT AS channel, round(theta, 6) AS theta, round(exp(-abs(cos(theta / 2) - 1) / 0.5::DOUBLE), 6) AS amplitude FROM q""")
def h05_synthetic_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("channel"), cal.synthetic_phase(F.col("d"), p).alias("theta")) for i, p in enumerate(cal.PERIODS)])
    return days(spark, sf_dir).select("d", F.inline(listed)).select("d", "channel", F.round("theta", 6).alias("theta"), F.round(cal.synthetic_amplitude(F.col("theta")), 6).alias("amplitude"))


@query(f"""WITH {_DAYS}, {_EVENTS}, packed AS (SELECT d, list(amp ORDER BY c) AS a FROM phased GROUP BY d), v AS (
    SELECT d, a, list_reverse_sort(a) AS r, ['earnings', 'fed', 'options_expiry', 'rebalance', 'holiday'] AS names, list_filter(['earnings', 'fed', 'options_expiry', 'rebalance', 'holiday'], lambda x: a[list_position(names, x)] > 0.3::DOUBLE) AS act FROM (SELECT d, a, ['earnings', 'fed', 'options_expiry', 'rebalance', 'holiday'] AS names FROM packed))
    SELECT d, names[list_position(a, r[1])] AS dominant_cycle, r[2] > 0.05::DOUBLE AND r[1] / (r[2] + 1e-12::DOUBLE) <= 2.5::DOUBLE AS resonance_detected, round(1 + r[1] * 0.2::DOUBLE, 3) AS vol_multiplier,
           upper(CASE WHEN len(act) > 0 THEN array_to_string(act[1:2], '+') ELSE names[list_position(a, r[1])] END) AS regime_label FROM v""")
def h06_phase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ops.pack(ops.phases(days(spark, sf_dir)))
    return packed.select("d", *[c.alias(k) for k, c in cal.phase_view(F.col("amplitudes"), F.col("active_events")).items()])


@query(f"WITH {_DAYS}, {_EVENTS} SELECT d, c::INT AS channel, round(theta, 6) AS theta, round(amp, 6) AS amplitude FROM phased")
def c01_nearest_event_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.phases(days(spark, sf_dir)).select("d", F.posexplode(F.arrays_zip("theta", "amplitudes")).alias("channel", "x")).select("d", "channel", F.round("x.theta", 6).alias("theta"), F.round("x.amplitudes", 6).alias("amplitude"))


@query(f"""WITH {_DAYS}, ev AS (SELECT *, row_number() OVER (ORDER BY e) AS ord FROM (SELECT DISTINCT date_trunc('month', d)::DATE + 14 AS e FROM days)),
    n AS (SELECT d, arg_min(dist, (abs(dist), ord)) AS dist FROM (SELECT d, ord, {_W.format('e')} - {_W.format('d')} AS dist FROM days, ev) GROUP BY d)
    SELECT d, round((2 * pi() * dist / 31.5::DOUBLE) % (2 * pi()) + CASE WHEN dist < 0 AND (2 * pi() * dist / 31.5::DOUBLE) % (2 * pi()) < 0 THEN 2 * pi() ELSE 0 END, 6) AS theta, round(exp(-abs(dist) / 2.0::DOUBLE), 6) AS amplitude FROM n""")
def c01_nearest_listed_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against an explicit table of events."""
    d = days(spark, sf_dir)
    events = d.select(F.date_add(F.trunc("d", "month"), 14).alias("d")).distinct().select(F.lit("fed").alias("kind"), "d", F.datediff("d", F.to_date(F.lit("1970-01-01"))).alias("ord"))
    return ops.nearest_event_phase(d, events, "fed").select("d", F.round("theta", 6).alias("theta"), F.round("amplitude", 6).alias("amplitude"))


_ANCHORED = """anchored AS (SELECT d, CASE WHEN d BETWEEN DATE '1997-07-02' AND DATE '1997-12-31' THEN 'asia_crisis' WHEN d BETWEEN DATE '1997-10-01' AND DATE '1998-10-15' THEN 'autumn_1997' END AS name FROM days)"""


@query(f"WITH {_DAYS}, {_ANCHORED} SELECT d, CASE WHEN name IS NOT NULL THEN 'historical:' || name END AS anchor FROM anchored")
def c02_interval_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.apply_anchors(ops.phases(days(spark, sf_dir)), anchors(spark)).select("d", F.col("active_events")[0].alias("anchor"))


@query(f"""WITH {_DAYS}, {_EVENTS}, {_ANCHORED}, daily AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    packed AS (SELECT d, list(amp ORDER BY c) AS a, list(theta ORDER BY c) AS t FROM phased GROUP BY d),
    x AS (SELECT p.d, CASE name WHEN 'asia_crisis' THEN [0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5] WHEN 'autumn_1997' THEN [1.0::DOUBLE, 2.0, 3.0, 1.0, 2.0] ELSE t END AS t,
                 CASE name WHEN 'asia_crisis' THEN list_transform(a, lambda x: 0.9::DOUBLE) WHEN 'autumn_1997' THEN list_transform(a, lambda x: 0.7::DOUBLE) ELSE a END AS a, name, total,
                 ['earnings', 'fed', 'options_expiry', 'rebalance', 'holiday'] AS names FROM packed p JOIN anchored USING (d) JOIN daily USING (d))
    SELECT d, round(t[1], 6) AS theta_earnings, round(t[2], 6) AS theta_fed, round(t[3], 6) AS theta_options, round(t[4], 6) AS theta_rebalance, round(t[5], 6) AS theta_holiday,
           CASE WHEN name IS NOT NULL THEN 'historical:' || name ELSE array_to_string(list_filter(names, lambda c: a[list_position(names, c)] > 0.3::DOUBLE), '+') END AS active_events,
           round(a[1] * 0.6::DOUBLE, 6) AS prior_earnings, round(a[2] * 0.8::DOUBLE, 6) AS prior_fed, round(total, 2) AS order_value,
           round((total - lag(total) OVER (ORDER BY d)) / lag(total) OVER (ORDER BY d), 6) AS momentum FROM x""")
def calendar_order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order date: phases in five cycles, active events, the prior, and the order value's momentum."""
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("total"))
    packed = ops.pack(ops.apply_anchors(ops.phases(ops.momentum(daily.withColumn("all", F.lit(1)), ["all"], "d", "total")), anchors(spark)))
    names = ["earnings", "fed", "options", "rebalance", "holiday"]
    return packed.select(
        "d", *[F.round(F.col("theta")[i], 6).alias(f"theta_{c}") for i, c in enumerate(names)], F.array_join("active_events", "+").alias("active_events"),
        F.round(F.col("regime_prior")[0], 6).alias("prior_earnings"), F.round(F.col("regime_prior")[1], 6).alias("prior_fed"), F.round("total", 2).alias("order_value"), F.round("momentum", 6).alias("momentum"),
    )
