"""Window and market queries: daily order value by segment as prices, events as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import market, spectral
from tidegauge.operators import calendar as cal_ops
from tidegauge.operators import windows as win
from tidegauge.plans.registry import query, table

_DAILY = "daily AS (SELECT c_mktsegment AS ticker, o_orderdate::DATE AS d, sum(o_totalprice) / 99991 AS price, count(*)::DOUBLE AS volume, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate::DATE) AS i FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_TICKS = "ticks AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 99991).alias("price"), F.count("*").cast("double").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {_DAILY} SELECT ticker, d, round(avg(price) OVER w, 6) AS sma FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) QUALIFY i >= 20")
def e01_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.sma(daily(spark, sf_dir), ["ticker"], "d", "price", 20).select("ticker", "d", *r6("sma"))


def _ema_sql(n: int, column: str, source: str) -> str:
    return f"SELECT ticker, i, {column} AS y FROM {source} WHERE i = 1 UNION ALL SELECT s.ticker, s.i, e.y + 2.0::DOUBLE / {n + 1} * (s.{column} - e.y) FROM {{name}} e JOIN {source} s ON s.ticker = e.ticker AND s.i = e.i + 1"


@query(f"WITH RECURSIVE {_DAILY}, e AS ({_ema_sql(12, 'price', 'daily').format(name='e')}) SELECT ticker, d, round(y, 6) AS ema FROM e JOIN daily USING (ticker, i)")
def e02_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.ema(daily(spark, sf_dir), ["ticker"], "d", "price", 12).select("ticker", "d", *r6("ema"))


@query(f"""WITH RECURSIVE {_DAILY}, ch AS (SELECT *, price - lag(price) OVER (PARTITION BY ticker ORDER BY d) AS c FROM daily),
    seed AS (SELECT ticker, avg(greatest(c, 0)) AS up, avg(greatest(-c, 0)) AS down FROM ch WHERE i BETWEEN 2 AND 15 GROUP BY ticker),
    r AS (SELECT ticker, 15::BIGINT AS i, up, down FROM seed UNION ALL SELECT ch.ticker, ch.i, (r.up * 13 + greatest(c, 0)) / 14, (r.down * 13 + greatest(-c, 0)) / 14 FROM r JOIN ch ON ch.ticker = r.ticker AND ch.i = r.i + 1)
    SELECT ticker, d, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM r JOIN daily USING (ticker, i)""")
def e03_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.rsi(daily(spark, sf_dir), ["ticker"], "d", "price", 14).select("ticker", "d", *r6("rsi"))


@query(f"""WITH RECURSIVE {_DAILY}, f AS ({_ema_sql(12, 'price', 'daily').format(name='f')}), s AS ({_ema_sql(26, 'price', 'daily').format(name='s').replace('daily s ', 'daily q ').replace('s.', 'q.')}),
    m AS MATERIALIZED (SELECT ticker, i, f.y - s.y AS macd FROM f JOIN s USING (ticker, i)), g AS ({_ema_sql(9, 'macd', 'm').format(name='g')})
    SELECT ticker, d, round(macd, 6) AS macd, round(g.y, 6) AS signal, round(macd - g.y, 6) AS histogram FROM g JOIN m USING (ticker, i) JOIN daily USING (ticker, i)""")
def e04_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.macd(daily(spark, sf_dir), ["ticker"], "d", "price").select("ticker", "d", *r6("macd", "signal", "histogram"))


@query(f"WITH {_DAILY} SELECT ticker, d, round(avg(price) OVER w, 6) AS mid, round(avg(price) OVER w + 2 * stddev_pop(price) OVER w, 6) AS upper, round(avg(price) OVER w - 2 * stddev_pop(price) OVER w, 6) AS lower FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) QUALIFY i >= 20")
def e05_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.bollinger(daily(spark, sf_dir), ["ticker"], "d", "price").select("ticker", "d", *r6("mid", "upper", "lower"))


@query(f"WITH {_DAILY}, n AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM daily) SELECT ticker, d, round(CASE WHEN n < 30 THEN price ELSE sqrt(2 * avg(price * price) OVER w) END, 6) AS slow, round(CASE WHEN n < 30 THEN 0 ELSE price - avg(price) OVER w END, 6) AS fast FROM n WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)")
def e06_dual_timescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.dual_timescale(daily(spark, sf_dir), ["ticker"], "d", "price", 30).select("ticker", "d", *r6("slow", "fast"))


@query(f"WITH {_TICKS} SELECT user_id, event_id, value FROM ticks QUALIFY (value - lag(value) OVER w) * (lead(value) OVER w - value) < 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts)".replace("QUALIFY (value - lag(value) OVER w) * (lead(value) OVER w - value) < 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts)", "WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY (value - lag(value) OVER w) * (lead(value) OVER w - value) < 0"))
def e07_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.folds(ticks(spark, sf_dir), ["user_id"], "ts", "value").select("user_id", "event_id", "value")


@query(f"""WITH {_DAILY}, x AS (SELECT *, lag(price) OVER w AS p, lag(volume) OVER w AS v FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d)), f AS (SELECT ticker, d, (price > 3) <> (p > 3) AS a, (volume > 3) <> (v > 3) AS b FROM x WHERE p IS NOT NULL)
    SELECT ticker, d, (a::INT + b::INT) AS n_flips, CASE WHEN a THEN 0 ELSE 1 END AS first_index FROM f WHERE a OR b""")
def e08_regime_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.regime_transitions(daily(spark, sf_dir).withColumn("x", F.array("price", "volume")), ["ticker"], "d", "x", 3.0).select("ticker", "d", "n_flips", "first_index")


_DYN = """dyn AS (SELECT *, CASE WHEN count(*) OVER s < 2 THEN 0 ELSE (value - first(value) OVER s) / (count(*) OVER s - 1) END AS velocity,
    CASE WHEN count(*) OVER l < 3 THEN 0 ELSE ((value - lag(value) OVER o) - (nth_value(value, 2) OVER l - first(value) OVER l)) / (count(*) OVER l - 2) END AS acceleration FROM ticks
    WINDOW o AS (PARTITION BY user_id ORDER BY ts), s AS (PARTITION BY user_id ORDER BY ts ROWS 10 PRECEDING), l AS (PARTITION BY user_id ORDER BY ts ROWS 20 PRECEDING))"""


@query(f"WITH {_TICKS}, {_DYN} SELECT user_id, event_id, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration FROM dyn")
def e10_consonance_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.consonance_dynamics(ticks(spark, sf_dir), ["user_id"], "ts", "value").select("user_id", "event_id", *r6("velocity", "acceleration"))


@query(f"""WITH {_TICKS.replace('event_type, value,', 'event_type, value / 497 AS value,')}, {_DYN}, en AS (SELECT *, avg(value * value) OVER (PARTITION BY user_id ORDER BY ts ROWS 9 PRECEDING) + 0.618::DOUBLE * velocity * velocity - 0.1::DOUBLE * abs(velocity) AS energy FROM dyn),
    p AS (SELECT *, lag(energy, 9) OVER (PARTITION BY user_id ORDER BY ts) AS e0, var_pop(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 19 PRECEDING) AS v FROM en)
    SELECT user_id, event_id, round(energy, 6) AS energy, round(-acceleration + CASE WHEN velocity <= 0 THEN 10 ELSE 0 END + CASE WHEN v > 0.01::DOUBLE THEN v * 100 ELSE 0 END
        + CASE WHEN i > 10 AND abs(energy - e0) / greatest(abs(e0), 1e-9::DOUBLE) > 0.05::DOUBLE THEN abs(energy - e0) * 10 ELSE 0 END, 6) AS meta_loss FROM p""")
def e11_meta_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.meta_loss(ticks(spark, sf_dir).withColumn("value", F.col("value") / 497), ["user_id"], "ts", "value").select("user_id", "event_id", *r6("energy", "meta_loss"))


@query(f"WITH {_TICKS}, {_DYN} SELECT user_id, round(arg_max(acceleration, ts), 6) AS acceleration FROM dyn GROUP BY user_id HAVING arg_max(acceleration, ts) > 0")
def e12_compounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.compounding(ticks(spark, sf_dir), ["user_id"], "ts", "value").select("user_id", *r6("acceleration"))


@query(f"""WITH {_TICKS}, m AS (SELECT *, (event_id % 7)::INT AS degree, (i // 3 + 1)::INT AS patches, (CASE WHEN event_id % 41 = 0 THEN 30 ELSE event_id % 3 END)::INT AS eq FROM ticks),
    w AS (SELECT user_id, event_id, value, patches, count(*) OVER f AS n, list(value) OVER f AS c, avg(value / 500) OVER f AS trust, max(degree) OVER f - min(degree) OVER f AS jump, first(patches) OVER f AS p0, list(eq::DOUBLE) OVER f AS e FROM m WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING))
    SELECT user_id, event_id, CASE WHEN n < 3 THEN '' ELSE array_to_string(list_filter([
        CASE WHEN len(list_filter(range(1, n), lambda k: c[k] > c[k + 1] + 0.01::DOUBLE * abs(c[k]))) = 0 AND list_avg(c[n // 2 + 1:]) > list_avg(c[:n // 2]) * 1.1::DOUBLE THEN 'curvature_monotone_increasing' END,
        CASE WHEN trust < 0.3::DOUBLE THEN 'mean_trust_too_low' END, CASE WHEN jump > 3 THEN 'degree_jump' END, CASE WHEN patches > 2 * p0 THEN 'patch_growth_excessive' END,
        CASE WHEN list_stddev_pop(e[:n - 1]) >= 1e-9::DOUBLE AND e[n] > list_avg(e[:n - 1]) + 3 * list_stddev_pop(e[:n - 1]) THEN 'equivalence_spike' END], lambda x: x IS NOT NULL), ',') END AS fired FROM w""")
def e13_geometry_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = ticks(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).select(
        "user_id", "event_id", "ts", F.col("value").alias("curvature"), (F.col("value") / 500).alias("trust"), (F.col("event_id") % 7).cast("int").alias("degree"), (F.floor(F.col("i") / 3) + 1).cast("int").alias("patch_count"),
        F.when(F.col("event_id") % 41 == 0, 30).otherwise((F.col("event_id") % 3).cast("int")).alias("n_equivalences"),
    )
    return win.geometry_monitor(rows, ["user_id"], "ts", width=5).select("user_id", "event_id", F.array_join("fired", ",").alias("fired"))


@query(f"""WITH {_DAILY}, r AS (SELECT ticker, d, (price - lag(price) OVER (PARTITION BY ticker ORDER BY d)) / lag(price) OVER (PARTITION BY ticker ORDER BY d) AS r FROM daily),
    c AS (SELECT *, sum(r) OVER w AS cumulative, coalesce(var_samp(r) OVER w, 0) AS variance, avg(r) OVER w AS m, count(*) OVER w AS n FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, greatest(max(cumulative) OVER w, 0) - cumulative AS dd FROM c WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING))
    SELECT ticker, d, round(cumulative, 6) AS cumulative, round(variance, 6) AS variance, round(max(dd) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS drawdown, round(CASE WHEN n >= 20 THEN m / sqrt(greatest(variance, 1e-15)) ELSE 0 END, 6) AS sharpe FROM p""")
def e16_profit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = cal_ops.momentum(daily(spark, sf_dir), ["ticker"], "d", "price").where("momentum is not null")
    return win.profit_window(returns, ["ticker"], "d", "momentum").select("ticker", "d", *r6("cumulative", "variance", "drawdown", "sharpe"))


@query(f"""WITH {_DAILY}, x AS (SELECT ticker, d, ln(greatest(price, 1e-30)) AS r, i - lag(i) OVER w AS step FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d))
    SELECT ticker, d, round((r - lag(r) OVER (PARTITION BY ticker ORDER BY d)) / step, 6) AS curvature FROM x""")
def e17_curvature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = daily(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("d")))
    return win.curvature_profile(rows, ["ticker"], "d", "i", "price").select("ticker", "d", *r6("curvature"))


@query(f"WITH {_TICKS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM ticks) WHERE r <= 10")
def e19_keep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.keep_recent(ticks(spark, sf_dir), ["user_id"], "ts", 10).select("user_id", "event_id")


@query(f"WITH {_TICKS}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ticks) SELECT user_id, event_id FROM x WHERE n <= 20 OR r <= 6 OR (n - r) % greatest(1, (n - 6) // 14) = 0")
def e19_compress_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.compress_history(ticks(spark, sf_dir), ["user_id"], "ts", 20).select("user_id", "event_id")


@query(f"WITH {_TICKS}, s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ticks) SELECT user_id, event_id, round(CASE WHEN p <> 0 THEN (value - p) / p END, 6) AS momentum FROM s")
def e20_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null for a user's first event and after a value of zero, of which no share can be told; equal times go by id. Rounded
    as SQL does, on the millionfold."""
    return cal_ops.momentum(ticks(spark, sf_dir), ["user_id"], F.struct("ts", "event_id"), "value").select("user_id", "event_id", (F.round(F.col("momentum") * 1e6) / 1e6).alias("momentum"))


_RATIOS = ", ".join(f"{p / q!r}::DOUBLE" for p, q in spectral.rationals(4))


@query(f"""WITH {_TICKS}, s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ticks)
    SELECT user_id, round(sum(CASE WHEN p IS NULL THEN NULL WHEN abs(value) < 1e-12::DOUBLE OR abs(p) < 1e-12::DOUBLE THEN 0 ELSE list_min(list_transform([{_RATIOS}], lambda r: abs(value - r * p))) END), 4) AS dissonance FROM s GROUP BY user_id""")
def e21_path_dissonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from or to a value of zero count 0; equal times go by id."""
    return win.path_dissonance(ticks(spark, sf_dir), ["user_id"], F.struct("ts", "event_id"), "value", 4).select("user_id", F.round("dissonance", 4).alias("dissonance"))


@query(f"WITH {_TICKS}, f AS (SELECT user_id, min(CASE WHEN abs(value) > 480 THEN ts END) AS a, min(CASE WHEN value < 1 THEN ts END) AS b, min(CASE WHEN event_type = 'purchase' THEN ts END) AS c FROM ticks GROUP BY user_id) SELECT user_id, coalesce(a, b, c) AS at, CASE WHEN a IS NOT NULL THEN 'curvature' WHEN b IS NOT NULL THEN 'ratio' WHEN c IS NOT NULL THEN 'marginal' END AS reason FROM f")
def e23_first_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.first_warning(ticks(spark, sf_dir).withColumn("m", F.col("event_type") == "purchase"), ["user_id"], "ts", "value", "value", "m", 480.0, 1.0)


_VOL = "vol AS (SELECT user_id, stddev_pop(value) / 3000 AS vol FROM events GROUP BY user_id)"


def _vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("user_id").agg((F.stddev_pop("value") / 3000).alias("vol"))


@query(f"WITH {_VOL} SELECT user_id, CASE WHEN vol < 0.02::DOUBLE THEN 0 WHEN vol < 0.05::DOUBLE THEN 1 ELSE 2 END AS regime, round(least(1, greatest(0.1::DOUBLE, CASE WHEN vol < 0.02::DOUBLE THEN 1 - vol / 0.02::DOUBLE WHEN vol < 0.05::DOUBLE THEN 1 - abs(vol - 0.035::DOUBLE) / 0.015::DOUBLE ELSE least(1, vol / 0.05::DOUBLE - 1) END)), 6) AS confidence FROM vol")
def b01_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime codes and their confidence."""
    return _vols(spark, sf_dir).select("user_id", market.regime_id(F.col("vol")).alias("regime"), F.round(market.regime_confidence(F.col("vol")), 6).alias("confidence"))


@query(f"WITH {_VOL}, m AS (SELECT avg(vol) AS v FROM vol) SELECT CASE WHEN v < 0.02::DOUBLE THEN 0 WHEN v < 0.05::DOUBLE THEN 1 ELSE 2 END AS regime, round(v, 6) AS mean_vol FROM m")
def d01_market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _vols(spark, sf_dir).agg(F.avg("vol").alias("v"))
    return mean.select(market.regime_id(F.col("v")).alias("regime"), F.round("v", 6).alias("mean_vol"))


@query("""WITH x AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, round(coalesce(max(v) FILTER (event_type = 'click'), 0), 6) AS click, round(coalesce(max(v) FILTER (event_type = 'purchase'), 0), 6) AS purchase, round(coalesce(max(v) FILTER (event_type = 'view'), 0), 6) AS view FROM x GROUP BY user_id""")
def b03_assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.statistics import assemble_features

    long = ticks(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return assemble_features(long, ["user_id"], "event_type", "v", ["click", "purchase", "view"]).select("user_id", *r6("click", "purchase", "view"))


@query("""WITH x AS (SELECT user_id, stddev_pop(value) / 300 AS s, stddev_pop(value) / 200 AS l, avg(value) / 500 AS t, count(*)::DOUBLE AS n FROM events GROUP BY user_id)
    SELECT user_id, round(greatest(0.1::DOUBLE, 1 - abs(t) + s), 6) AS alpha, round(greatest(0.01::DOUBLE, 0.1::DOUBLE * s / greatest(l, 1e-10)), 6) AS beta, round(least(1, n / (30 + 100 * s)), 6) AS stability FROM x""")
def b04_regime_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ticks(spark, sf_dir).groupBy("user_id").agg((F.stddev_pop("value") / 300).alias("s"), (F.stddev_pop("value") / 200).alias("l"), (F.avg("value") / 500).alias("t"), F.count("*").cast("double").alias("n"))
    return x.select("user_id", *[F.round(c, 6).alias(k) for k, c in market.regime_scalars(F.col("s"), F.col("l"), F.col("t"), F.col("n")).items()])


@query("SELECT vec_id, round(least(1, list_var_pop(list_transform(embedding, lambda x: x::DOUBLE)) / (list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) + 1e-10)), 6) AS score FROM embeddings")
def b05_linearity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(market.linearity_score(F.col("embedding").cast("array<double>")), 6).alias("score"))


@query("WITH x AS (SELECT event_id, value / 500 AS r, (event_id % 100) / 100.0::DOUBLE AS c FROM events) SELECT event_id, CASE WHEN r > 0.7::DOUBLE THEN 'exit' WHEN r > 0.4::DOUBLE THEN 'reduce' WHEN c > 0.7::DOUBLE THEN 'increase' ELSE 'hold' END AS action, round(least(1, greatest(-1, 0.6::DOUBLE * r + 0.25::DOUBLE * tanh(c) + 0.15::DOUBLE * c)), 6) AS score FROM x")
def b10_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions and blended scores."""
    x = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("r"), ((F.col("event_id") % 100) / 100.0).alias("c"))
    return x.select("event_id", market.recommend(F.col("r"), F.col("c")).alias("action"), F.round(market.enhance_score(F.col("r"), F.col("c"), F.lit(1.0), F.col("c")), 6).alias("score"))


@query("SELECT vec_id, round(e, 6) AS energy FROM (SELECT vec_id, embedding[1]::DOUBLE * 1.0::DOUBLE + embedding[2]::DOUBLE * 0.5::DOUBLE + embedding[3]::DOUBLE * 0.25::DOUBLE AS e FROM embeddings) WHERE e <= 0.1::DOUBLE")
def b12_energy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", market.weighted_energy(F.slice(F.col("embedding").cast("array<double>"), 1, 3), [1.0, 0.5, 0.25]).alias("e"))
    return x.where(F.col("e") <= 0.1).select("vec_id", F.round("e", 6).alias("energy"))


@query(f"""WITH {_DAILY}, r AS (SELECT *, (price - lag(price) OVER w) / lag(price) OVER w AS r FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY d)), q AS (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY d) AS p FROM r)
    SELECT ticker, count(r) AS n, round(avg(r), 6) AS mean_return, round(stddev_pop(r), 6) AS std_return, round(corr(r, p), 6) AS autocorrelation, round(kurtosis_pop(r), 4) AS kurtosis, round((max(price) - min(price)) / avg(price), 6) AS spread, round(avg(volume), 6) AS mean_volume FROM q GROUP BY ticker""")
def d12_ohlcv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = win.ohlcv_features(daily(spark, sf_dir), ["ticker"], "d", "price", "volume")
    return f.select("ticker", "n", *r6("mean_return", "std_return", "autocorrelation"), F.round("kurtosis", 4).alias("kurtosis"), *r6("spread", "mean_volume"))


@query("SELECT event_type AS from_state, nxt AS to_state, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE nxt <> event_type GROUP BY ALL")
def d17_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.transition_counts(ticks(spark, sf_dir), ["user_id"], "ts", "event_type")


@query("WITH f AS (SELECT event_type, min(CASE WHEN value > 485 THEN event_id END) AS first_flag FROM events GROUP BY 1) SELECT f.event_type, f.first_flag, b.first_flag - f.first_flag AS lead FROM f, (SELECT first_flag FROM f WHERE event_type = 'click') b")
def d42_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.lead_time(ticks(spark, sf_dir), "event_type", "event_id", F.col("value") > 485, "click")


@query(f"""WITH {_TICKS}, {_DYN}, a AS (SELECT user_id, arg_max(acceleration, ts) AS acceleration FROM dyn GROUP BY 1), e AS (SELECT user_id, avg(abs(value - 250)) AS error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM ticks) WHERE r <= 50 GROUP BY 1)
    SELECT user_id, round(error, 6) AS error, round(error * greatest(acceleration, 0), 6) AS priority FROM e JOIN a USING (user_id)""")
def d47_ignorance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    acceleration = win.consonance_dynamics(t, ["user_id"], "ts", "value").groupBy("user_id").agg(F.max_by("acceleration", "ts").alias("acceleration"))
    return win.ignorance(t.withColumn("p", F.lit(250.0)), "user_id", "ts", "p", "value", acceleration).select("user_id", *r6("error", "priority"))


@query("WITH c AS (SELECT DISTINCT o_orderpriority AS p FROM orders UNION SELECT 'never'), r AS (SELECT o_orderpriority AS p, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1) SELECT p AS pattern, round(coalesce(rate, 0), 6) AS rate, coalesce(rate, 0) < 0.5::DOUBLE AS flagged FROM c LEFT JOIN r USING (p)")
def d48_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pattern"), (F.col("o_orderstatus") == "F").cast("int").alias("ok"))
    catalog = log.select("pattern").distinct().unionByName(spark.createDataFrame([("never",)], "pattern string"))
    return win.success_rates(log, catalog, "pattern", "ok").select("pattern", *r6("rate"), "flagged")


@query("SELECT event_id, round(exp(-greatest(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts), 0) / 3.6e9::DOUBLE / 24), 6) AS decay, round(exp(-ln(2) * greatest(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts), 0) / 8.64e10::DOUBLE / 7), 6) AS half_life FROM events")
def h49_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", F.round(market.time_decay(F.col("ts"), now, 24.0), 6).alias("decay"), F.round(market.half_life_decay(F.col("ts"), now), 6).alias("half_life"))


@query("SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def h51_json_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("WITH a AS (SELECT user_id, max(ts) FILTER (ts <= TIMESTAMP '2024-01-15') AS t FROM events GROUP BY 1) SELECT e.user_id, e.event_id, e.value FROM events e JOIN a ON a.user_id = e.user_id AND a.t = e.ts")
def j07_slice_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' latest state up to a time."""
    from tidegauge.streaming.states import slice_at

    return slice_at(ticks(spark, sf_dir), "user_id", "ts", F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("user_id", "event_id", "value")


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS ticks, max(ts) AS last_tick FROM events GROUP BY 1")
def j10_feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.streaming.states import feed_health

    return feed_health(ticks(spark, sf_dir), "ts").select("minute", "ticks", "last_tick")


@query("""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN value ELSE -value END AS impact FROM events)
    SELECT user_id, round(sum(impact * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9::DOUBLE / 48)), 4) AS shock, round(max(exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9::DOUBLE / 48)), 6) AS max_decay, round(arg_max(impact, ts), 6) AS last_impact FROM e GROUP BY user_id""")
def j03_shock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.streaming.states import shock_state

    e = ticks(spark, sf_dir).withColumn("impact", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")))
    out = shock_state(e, "user_id", "ts", "impact", F.to_timestamp(F.lit("2024-02-01 00:00:00")), 48.0)
    return out.select("user_id", F.round("shock", 4).alias("shock"), *r6("max_decay", "last_impact"))
