"""Window analytics over ordered series: moving averages, recursive indicators, monitors, profit tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = 0.618


def _w(key: list[str], order: str | Column):
    return Window.partitionBy(*key).orderBy(order)


def sma(df: DataFrame, key: list[str], order: str, value: str, n: int) -> DataFrame:
    """Adds `sma`, the mean of n rows; only full windows are given."""
    w = _w(key, order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("sma", F.avg(value).over(w.rowsBetween(-(n - 1), 0))).where(F.col("_n") >= n).drop("_n")


def linear_recurrence(df: DataFrame, key: list[str], order: str, value: str, decay: float, gain: float, out: str, chunk: int = 256) -> DataFrame:
    """Adds y with y_1 = x_1 and y_t = decay * y_(t-1) + gain * x_t. A series is folded in chunks that run in parallel;
    as the recurrence is affine, a chunk's start only enters its values by a power of `decay`. For a decay below 1, chunks
    so far back that this power is under 1e-300 add nothing, so that a chunk looks at a bounded number before it."""
    rows = df.withColumn("_i", F.row_number().over(_w(key, order)) - 1).withColumn("_c", F.floor(F.col("_i") / chunk).cast("long"))
    packed = rows.groupBy(*key, "_c").agg(F.sort_array(F.collect_list(F.struct("_i", F.struct(*df.columns).alias("row")))).alias("_rows"))
    x = lambda r: r["row"][value].cast("double")
    local = F.aggregate(
        "_rows", F.array().cast("array<double>"),
        lambda acc, r: F.concat(acc, F.array(F.when(r["_i"] == 0, x(r)).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * decay + x(r) * gain))),
    )
    packed = packed.withColumn("_local", local).withColumn("_size", F.size("_rows")).withColumn("_last", F.element_at("_local", -1))
    back = 1 + math.ceil(690 / (-math.log(decay) * chunk)) if 0 < decay < 1 else 0
    before = F.sort_array(F.collect_list(F.struct("_c", "_size", "_last")).over(Window.partitionBy(*key).orderBy("_c").rowsBetween(-back if back else Window.unboundedPreceding, -1)))
    carry = F.aggregate(before, F.lit(0.0), lambda acc, c: acc * F.pow(F.lit(decay), c["_size"]) + c["_last"])
    done = packed.withColumn("_carry", carry).select(*key, "_carry", F.posexplode(F.arrays_zip("_rows", "_local")).alias("_k", "_z"))
    return done.select("_z._rows.row.*", (F.col("_z._local") + F.col("_carry") * F.pow(F.lit(decay), F.col("_k") + 1)).alias(out))


def ema(df: DataFrame, key: list[str], order: str, value: str, n: int, out: str = "ema") -> DataFrame:
    a = 2.0 / (n + 1)
    return linear_recurrence(df, key, order, value, 1.0 - a, a, out)


def macd(df: DataFrame, key: list[str], order: str, value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    both = ema(ema(df, key, order, value, fast, "_fast"), key, order, value, slow, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(both, key, order, "macd", signal, "signal").withColumn("histogram", F.col("macd") - F.col("signal"))


def rsi(df: DataFrame, key: list[str], order: str, value: str, n: int = 14) -> DataFrame:
    """Adds Wilder's index from row n + 1 on; its first averages are plain means of the first n changes."""
    w = _w(key, order)
    change = F.col(value) - F.lag(value).over(w)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0)))
    first = w.rowsBetween(-(n - 1), 0)
    for c in ("_up", "_down"):
        rows = rows.withColumn(c, F.when(F.col("_i") == n + 1, F.avg(c).over(first)).otherwise(F.col(c)))
    rows = rows.where(F.col("_i") > n)
    for c in ("_up", "_down"):
        rows = linear_recurrence(rows, key, order, c, (n - 1) / n, 1.0 / n, f"{c}_mean")
    index = F.when(F.col("_down_mean") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_up_mean") / F.col("_down_mean")))
    return rows.withColumn("rsi", index).drop("_i", "_up", "_down", "_up_mean", "_down_mean")


def bollinger(df: DataFrame, key: list[str], order: str, value: str, n: int = 20, k: float = 2.0) -> DataFrame:
    w = _w(key, order)
    f = w.rowsBetween(-(n - 1), 0)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("mid", F.avg(value).over(f)).withColumn("_s", F.stddev_pop(value).over(f)).where(F.col("_n") >= n)
    return rows.withColumn("upper", F.col("mid") + k * F.col("_s")).withColumn("lower", F.col("mid") - k * F.col("_s")).drop("_n", "_s")


def dual_timescale(df: DataFrame, key: list[str], order: str, value: str, width: int) -> DataFrame:
    """Adds a slow envelope (root two times the RMS) and a fast residual over a centred frame cut at the ends; a series
    shorter than the frame is its own envelope."""
    f = _w(key, order).rowsBetween(-(width // 2), width // 2)
    n = F.count("*").over(Window.partitionBy(*key))
    slow = F.when(n < width, F.col(value)).otherwise(F.sqrt(2.0 * F.avg(F.col(value) * F.col(value)).over(f)))
    fast = F.when(n < width, F.lit(0.0)).otherwise(F.col(value) - F.avg(value).over(f))
    return df.withColumn("slow", slow).withColumn("fast", fast)


def folds(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows at which the slope changes its sign."""
    w = _w(key, order)
    return df.withColumn("_t", (F.col(value) - F.lag(value).over(w)) * (F.lead(value).over(w) - F.col(value))).where("_t < 0").drop("_t")


def regime_transitions(df: DataFrame, key: list[str], order: str, vector: str, threshold: float) -> DataFrame:
    """Rows at which components cross the threshold since the row before: how many, and the first one's index."""
    w = _w(key, order)
    flips = F.filter(F.transform(F.arrays_zip(F.col(vector).alias("now"), F.lag(vector).over(w).alias("was")), lambda x, i: F.when((x["now"] > threshold) != (x["was"] > threshold), i)), lambda i: i.isNotNull())
    return df.withColumn("_f", flips).where(F.size("_f") > 0).withColumn("n_flips", F.size("_f")).withColumn("first_index", F.col("_f")[0]).drop("_f")


def consonance_dynamics(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Adds velocity (mean of the last 10 differences) and acceleration (mean of the last 19 second differences)."""
    w = _w(key, order)
    short, long_ = w.rowsBetween(-10, 0), w.rowsBetween(-20, 0)
    n, m = F.count(value).over(short), F.count(value).over(long_)
    first, second = F.first(value).over(long_), F.nth_value(value, 2).over(long_)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("velocity", F.when(n < 2, 0.0).otherwise((F.col(value) - F.first(value).over(short)) / (n - 1))).withColumn("acceleration", F.when(m < 3, 0.0).otherwise((step - (second - first)) / (m - 2)))


def lyapunov_energy(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    v = F.col("velocity")
    last = _w(key, order).rowsBetween(-9, 0)
    return consonance_dynamics(df, key, order, value).withColumn("energy", F.avg(F.col(value) * F.col(value)).over(last) + GOLDEN * v * v - 0.1 * F.abs(v))


def meta_loss(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Adds minus the acceleration, with penalties for no growth, for swings and for drifting energy."""
    w = _w(key, order)
    rows = lyapunov_energy(df, key, order, value)
    var, before = F.var_pop(value).over(w.rowsBetween(-19, 0)), F.lag("energy", 9).over(w)
    drift = F.abs(F.col("energy") - before)
    penalty = (
        F.when(F.col("velocity") <= 0, 10.0).otherwise(0.0) + F.when(var > 0.01, var * 100).otherwise(0.0)
        + F.when((F.row_number().over(w) > 10) & (drift / F.greatest(F.abs(before), F.lit(1e-9)) > 0.05), drift * 10).otherwise(0.0)
    )
    return rows.withColumn("meta_loss", -F.col("acceleration") + penalty)


def compounding(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Keys whose latest acceleration is positive."""
    last = consonance_dynamics(df, key, order, value).groupBy(*key).agg(F.max_by("acceleration", order).alias("acceleration"))
    return last.where("acceleration > 0")


def stagnant(df: DataFrame, key: list[str], order: str, value: str, threshold: int = 10, still: float = 1e-6) -> DataFrame:
    """(key, velocity) of keys with at least `threshold` points whose mean step over the last ten is nearly zero."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_r") <= max(threshold, 10))
    ends = ranked.groupBy(*key).agg(F.count("*").alias("_n"), F.min_by(value, "_r").alias("_new"), F.max_by(value, F.when(F.col("_r") <= 10, F.col("_r"))).alias("_old"))
    velocity = F.when(F.col("_n") > 1, (F.col("_new") - F.col("_old")) / (F.least("_n", F.lit(10)) - 1)).otherwise(0.0)
    return ends.where(F.col("_n") >= threshold).select(*key, velocity.alias("velocity")).where(F.abs("velocity") < still)


def geometry_monitor(df: DataFrame, key: list[str], order: str, width: int = 20, least_trust: float = 0.3, most_jump: int = 3, growth: float = 2.0, sigmas: float = 3.0) -> DataFrame:
    """Adds `fired`, the names of the conditions that the last `width` rows violate. Columns read: curvature, trust,
    degree, patch_count, n_equivalences."""
    f = _w(key, order).rowsBetween(-(width - 1), 0)
    c, n = F.collect_list("curvature").over(f), F.count("*").over(f)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    half = F.floor(F.col("_n") / 2).cast("int")
    rising = F.forall(F.sequence(F.lit(0), F.col("_n") - 2), lambda i: F.get("_c", i) <= F.get("_c", i + 1) + 0.01 * F.abs(F.get("_c", i)))
    higher = mean(F.slice("_c", half + 1, F.col("_n"))) > mean(F.slice("_c", F.lit(1), half)) * 1.1
    earlier = F.slice("_e", F.lit(1), F.col("_n") - 1)
    e_mean = mean(earlier)
    e_std = F.sqrt(mean(F.transform(earlier, lambda x: (x - F.col("_em")) * (x - F.col("_em")))))
    rows = df.withColumn("_c", c).withColumn("_n", n.cast("int")).withColumn("_e", F.collect_list(F.col("n_equivalences").cast("double")).over(f))
    rows = rows.withColumn("_trust", F.avg("trust").over(f)).withColumn("_jump", F.max("degree").over(f) - F.min("degree").over(f)).withColumn("_p0", F.first("patch_count").over(f))
    rows = rows.withColumn("_ok", F.col("_n") >= 3).withColumn("_em", F.when(F.col("_ok"), e_mean)).withColumn("_es", F.when(F.col("_ok"), e_std))
    spike = (F.col("_es") >= 1e-9) & (F.element_at("_e", -1) > F.col("_em") + sigmas * F.col("_es"))
    names = [
        ("curvature_monotone_increasing", F.when(F.col("_ok"), rising & higher)), ("mean_trust_too_low", F.col("_trust") < least_trust), ("degree_jump", F.col("_jump") > most_jump),
        ("patch_growth_excessive", (F.col("_p0") != 0) & (F.col("patch_count") > growth * F.col("_p0"))), ("equivalence_spike", spike),
    ]
    fired = F.filter(F.array(*[F.when(F.col("_ok") & x, F.lit(name)) for name, x in names]), lambda x: x.isNotNull())
    return rows.withColumn("fired", fired).drop("_c", "_n", "_e", "_trust", "_jump", "_p0", "_ok", "_em", "_es")


def profit_window(df: DataFrame, key: list[str], order: str, ret: str, least: int = 20) -> DataFrame:
    """Adds the running return, variance, largest drawdown and, after `least` rows, Sharpe ratio of each key."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("cumulative", F.sum(ret).over(w)).withColumn("variance", F.coalesce(F.var_samp(ret).over(w), F.lit(0.0)))
    rows = rows.withColumn("_peak", F.greatest(F.max("cumulative").over(w), F.lit(0.0))).withColumn("drawdown", F.max(F.col("_peak") - F.col("cumulative")).over(w))
    sharpe = F.when(F.count("*").over(w) >= least, F.avg(ret).over(w) / F.sqrt(F.greatest("variance", F.lit(1e-15)))).otherwise(0.0)
    return rows.withColumn("sharpe", sharpe).drop("_peak")


def curvature_profile(df: DataFrame, key: list[str], order: str, log_energy: str, ratio: str) -> DataFrame:
    w = _w(key, order)
    r = F.ln(F.greatest(F.col(ratio), F.lit(1e-30)))
    step = F.col(log_energy) - F.lag(log_energy).over(w)
    return df.withColumn("_r", r).withColumn("curvature", (F.col("_r") - F.lag("_r").over(w)) / F.when(F.abs(step) > 1e-9, step).when(step.isNotNull(), 1e-9)).drop("_r")


def keep_recent(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def compress_history(df: DataFrame, key: list[str], order: str, n: int, recent: float = 0.3) -> DataFrame:
    """The latest share of n rows, and of the older ones every k-th, about n in all."""
    w = Window.partitionBy(*key)
    new = int(n * recent)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_n", F.count("*").over(w))
    stride = F.greatest(F.lit(1), F.floor((F.col("_n") - new) / (n - new)).cast("int"))
    return rows.where((F.col("_n") <= n) | (F.col("_r") <= new) | ((F.col("_n") - F.col("_r")) % stride == 0)).drop("_r", "_n")


def path_dissonance(df: DataFrame, key: list[str], order: str | Column, frequency: str, largest: int = 8) -> DataFrame:
    """Each key's sum of dissonances between neighbours."""
    from tidegauge.functions.spectral import dissonance

    before = F.lag(frequency).over(_w(key, order))
    steps = df.withColumn("_t", F.when(before.isNotNull(), dissonance(F.col(frequency), before, largest)))
    return steps.groupBy(*key).agg(F.sum("_t").alias("dissonance"))


def first_warning(df: DataFrame, key: list[str], order: str, curvature: str, ratio: str, marginal: str, most_curvature: float, least_ratio: float) -> DataFrame:
    """Each key's first row that bends too much, else the first with too low a ratio, else the first marginal one."""
    at = lambda c: F.min(F.when(c, F.col(order)))
    found = df.groupBy(*key).agg(at(F.abs(curvature) > most_curvature).alias("_a"), at(F.col(ratio) < least_ratio).alias("_b"), at(F.col(marginal)).alias("_c"))
    reason = F.when(F.col("_a").isNotNull(), "curvature").when(F.col("_b").isNotNull(), "ratio").when(F.col("_c").isNotNull(), "marginal")
    return found.select(*key, F.coalesce("_a", "_b", "_c").alias("at"), reason.alias("reason"))


def ohlcv_features(df: DataFrame, key: list[str], order: str, price: str, volume: str) -> DataFrame:
    """Each key's return statistics: mean, population deviation, lag-1 correlation, excess kurtosis, spread, volume."""
    w = _w(key, order)
    r = df.withColumn("_r", (F.col(price) - F.lag(price).over(w)) / F.lag(price).over(w))
    r = r.withColumn("_p", F.lag("_r").over(w))
    return r.groupBy(*key).agg(
        F.count("_r").alias("n"), F.avg("_r").alias("mean_return"), F.stddev_pop("_r").alias("std_return"), F.corr("_r", "_p").alias("autocorrelation"), F.kurtosis("_r").alias("kurtosis"),
        ((F.max(price) - F.min(price)) / F.avg(price)).alias("spread"), F.avg(volume).alias("mean_volume"),
    )


def lead_time(df: DataFrame, by: str, parameter: str, flag: Column, baseline: str) -> DataFrame:
    """The first parameter at which each detector flags, and how far it comes before the baseline's."""
    first = df.groupBy(by).agg(F.min(F.when(flag, F.col(parameter))).alias("first_flag"))
    base = first.where(F.col(by) == baseline).select(F.col("first_flag").alias("_base"))
    return first.join(F.broadcast(base), F.lit(True)).select(by, "first_flag", (F.col("_base") - F.col("first_flag")).alias("lead"))


def transition_counts(df: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    after = df.withColumn("to_state", F.lead(state).over(_w(key, order)))
    return after.where(F.col("to_state").isNotNull() & (F.col("to_state") != F.col(state))).groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n"))


def ignorance(df: DataFrame, level: str, order: str, predicted: str, observed: str, acceleration: DataFrame) -> DataFrame:
    """Mean absolute error of each level's last 50 predictions, and its priority: error times positive acceleration."""
    errors = keep_recent(df, [level], order, 50).groupBy(level).agg(F.avg(F.abs(F.col(predicted) - F.col(observed))).alias("error"))
    return errors.join(acceleration, level).select(level, "error", (F.col("error") * F.greatest(F.col("acceleration"), F.lit(0.0))).alias("priority"))


def success_rates(log: DataFrame, catalog: DataFrame, pattern: str, success: str) -> DataFrame:
    """Success rate of every pattern of the catalog, 0 for those never applied; flagged below one half."""
    rate = log.groupBy(pattern).agg(F.avg(F.col(success).cast("double")).alias("_rate"))
    return catalog.select(pattern).distinct().join(rate, pattern, "left").select(pattern, F.coalesce("_rate", F.lit(0.0)).alias("rate"), (F.coalesce("_rate", F.lit(0.0)) < 0.5).alias("flagged"))
