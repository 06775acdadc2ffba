"""Regime operators over phases, modes and horizons."""

from __future__ import annotations

from collections.abc import Callable

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import market, spectral
from tidegauge.operators.blocks import in_blocks

HORIZONS = ["long", "medium", "short"]


def detect_resonance(phased: DataFrame, key: str, eps: float = 0.3, largest: int = 4) -> DataFrame:
    """(key, i, j, p, q, width) of channel pairs, both over 0.05, whose phases stand in a small ratio within the width of
    its tongue, eps^q 2 / (p + q). phased: (key, theta, amplitudes)."""
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(eps**q * 2.0 / (p + q)).alias("width")) for p, q in spectral.rationals(largest)])
    ch = phased.select(key, F.posexplode(F.arrays_zip("theta", "amplitudes")).alias("c", "x")).select(key, "c", F.col("x.theta").alias("t"), F.col("x.amplitudes").alias("a")).where("a > 0.05")
    pairs = ch.alias("x").join(ch.alias("y"), key).where("x.c < y.c").select(key, F.col("x.c").alias("i"), F.col("y.c").alias("j"), F.col("x.t").alias("ti"), F.col("y.t").alias("tj"), F.inline(table))
    apart = F.pmod(F.col("q") * F.col("ti") - F.col("p") * F.col("tj") + math.pi, F.lit(2 * math.pi)) - math.pi
    return pairs.where(F.abs(apart) <= F.col("width")).select(key, "i", "j", "p", "q", "width")


def mix_horizons(df: DataFrame, logits: str, predictions: str, calendar: str | None = None, calendar_shift: list[list[float]] | None = None, regime: str | None = None, regime_shift: list[list[float]] | None = None, tongues: str | None = None) -> DataFrame:
    """Adds `weights` (softmax of the logits, moved by calendar amplitudes and regime shares), `blended` (their mean of the
    predictions, less 15 % a resonance tongue) and `dominant`."""
    x = F.col(logits)
    for name, shift in ((calendar, calendar_shift), (regime, regime_shift)):
        if name:
            moved = [sum((F.lit(float(r[h])) * F.get(F.col(name), F.lit(k)) for k, r in enumerate(shift)), F.lit(0.0)) for h in range(len(shift[0]))]
            x = F.zip_with(x, F.array(*moved), lambda a, b: a + b)
    out = df.withColumn("_x", x).withColumn("weights", market.softmax(F.col("_x"))).drop("_x")
    held = F.greatest(F.lit(0.0), 1 - 0.15 * F.col(tongues)) if tongues else F.lit(1.0)
    return out.withColumn("blended", market.dot(F.col("weights"), F.col(predictions)) * held).withColumn("dominant", market.argmax_label(F.col("weights"), HORIZONS))


def mix_predictors(df: DataFrame, predictors: dict[str, Callable[[], dict[str, Column]]], confidence: float = 1.0, linearity: float = 0.5, gap: float = 0.3, **shifts) -> DataFrame:
    """`mix_horizons` of pluggable predictors, one for each of HORIZONS. A predictor is a function that gives expressions over
    df's columns: `value`, and, if it has them, `confidence`, `linearity` and `gap`, whose weighted sum (confidence less
    linearity plus gap) is the horizon's logit. `shifts` are the calendar, regime and tongue arguments of `mix_horizons`."""
    told = [predictors[h]() for h in HORIZONS]
    of = lambda t, name: t.get(name, F.lit(0.0))
    logits = F.array(*[confidence * of(t, "confidence") - linearity * of(t, "linearity") + gap * of(t, "gap") for t in told])
    rows = df.withColumn("_logits", logits).withColumn("predictions", F.array(*[t["value"] for t in told]))
    return mix_horizons(rows, "_logits", "predictions", **shifts).drop("_logits")


def horizon_predictions(value: Column, trend: Column, rsi: Column, sentiment: Column, trust: Column, decay: Column) -> dict[str, Column]:
    """A prediction for each horizon: value, trend with the index's distance from 50, and decayed trusted sentiment."""
    return {"long": F.tanh(value), "medium": F.tanh(trend + (50 - rsi) / 100), "short": sentiment * trust * decay}


def bifurcation_status(df: DataFrame, key: list[str], order: str, spectrum: str, near: float = 0.05) -> DataFrame:
    """Adds status, type and features of each row's spectrum against the one before: critical when the largest real part
    is within `near` of zero, a bifurcation when it has become positive; hopf with an imaginary part, else saddle_node."""
    w = Window.partitionBy(*key).orderBy(order)
    top = F.array_max(F.transform(spectrum, lambda z: F.struct(z["re"].alias("re"), F.abs(z["im"]).alias("im"))))
    rows = df.withColumn("_re", top["re"]).withColumn("_im", top["im"])
    before = F.lag("_re").over(w)
    status = F.when((before < 0) & (F.col("_re") >= 0), "bifurcation").when(F.abs("_re") <= near, "critical").otherwise("stable")
    kind = F.when(status == "stable", None).when(F.col("_im") > 1e-6, "hopf").otherwise("saddle_node")
    features = F.array(F.col("_re"), F.abs("_re"), F.coalesce(F.col("_re") - before, F.lit(0.0)), F.array_max(F.transform(spectrum, lambda z: F.abs(z["im"]))))
    return rows.withColumn("status", status).withColumn("type", kind).withColumn("features", features).drop("_re", "_im")


def profile_signature(profile: Column, n: int) -> Column:
    """A profile at n even places by linear interpolation, over its norm."""
    size = F.size(profile)
    at = lambda k: k * (size - 1) / float(max(n - 1, 1))
    lo = lambda k: F.floor(at(k)).cast("int")
    value = lambda k: F.get(profile, lo(k)) + (at(k) - lo(k)) * (F.get(profile, F.least(lo(k) + 1, size - 1)) - F.get(profile, lo(k)))
    return market.normalized(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))


def compare_profiles(a: Column, b: Column) -> Column:
    """Cosine of two signatures; 1 for two flat ones, 0 for a flat one and another."""
    flat = lambda v: market.norm(v) < 1e-12
    return F.when(flat(a) & flat(b), 1.0).when(flat(a) | flat(b), 0.0).otherwise(market.dot(a, b))


def spectral_energy(modes: DataFrame, key: str, target: float) -> DataFrame:
    """Four energies of each key's modes (alpha, omega, idx): instability, lack of damping, distance to a frequency, and
    dissonance of pairs."""
    one = modes.groupBy(key).agg(F.sum(F.greatest(F.col("alpha"), F.lit(0.0)) ** 2).alias("e_stab"), F.sum(1 / (1 + F.abs("alpha"))).alias("e_damp"), F.sum((F.col("omega") - target) ** 2).alias("e_freq"))
    two = modes.alias("x").join(modes.alias("y"), key).where("x.idx < y.idx").groupBy(key).agg(F.sum(spectral.dissonance(F.col("x.omega"), F.col("y.omega"))).alias("e_harm"))
    return one.join(two, key, "left").na.fill(0.0, ["e_harm"])


def frequency_signature(modes: DataFrame, key: str, dim: int, f_max: float, d_max: float) -> DataFrame:
    """(key, dim, weight): magnitudes of modes (frequency, decay, magnitude) in buckets of frequency and decay, summing to 1."""
    side = int(math.sqrt(dim))
    cell = lambda c, most: F.least(F.floor(F.abs(c) / most * side), F.lit(side - 1)).cast("int")
    rows = modes.groupBy(key, (cell("frequency", f_max) * side + cell("decay", d_max)).alias("dim")).agg(F.sum("magnitude").alias("_m"))
    return rows.withColumn("weight", F.col("_m") / F.sum("_m").over(Window.partitionBy(key))).drop("_m")


def basin_gates(modes: DataFrame, key: str, eps: float, delta: float) -> DataFrame:
    """(key, stable, resonant, separated, inside): all modes damped, all pairs near a small ratio, the smallest distance of
    two modes over delta."""
    x, y = F.col("x.omega"), F.col("y.omega")
    pairs = modes.alias("x").join(modes.alias("y"), key).where("x.idx < y.idx").groupBy(key).agg(F.max(spectral.dissonance(F.lit(1.0), x / y)).alias("_t"), F.min(F.hypot(F.col("x.alpha") - F.col("y.alpha"), x - y)).alias("_g"))
    gates = modes.groupBy(key).agg((F.max("alpha") < 0).alias("stable")).join(pairs, key, "left")
    gates = gates.withColumn("resonant", F.coalesce(F.col("_t") <= eps, F.lit(True))).withColumn("separated", F.coalesce(F.col("_g") > delta, F.lit(True))).drop("_t", "_g")
    return gates.withColumn("inside", F.col("stable") & F.col("resonant") & F.col("separated"))


def resonance_score(consonance_a: Column, consonance_b: Column, same: Column, a: Column, b: Column) -> Column:
    return 0.4 * (1 - F.abs(consonance_a - consonance_b)) + 0.2 * same.cast("double") + 0.4 * market.cosine(a, b)


def duffing_params(kurtosis: Column, autocorrelation: Column, std: Column, n: Column) -> dict[str, Column]:
    """Mean reversion, cubic reaction and damping from return statistics; plain values under five returns."""
    pick = lambda c, plain: F.when(n < 5, plain).otherwise(c)
    return {"alpha": pick(F.greatest(F.lit(0.1), 1 - autocorrelation), 1.0), "beta": pick(F.greatest(F.lit(0.0), kurtosis / 10), 0.1), "delta": pick(F.greatest(F.lit(0.01), std), 0.3)}


def perf_invariants(throughput: Column, intensity: Column, ratio: Column) -> Column:
    log = lambda c: market.clip(F.ln(F.greatest(c, F.lit(1e-12))), -3.0, 3.0)
    return F.array(log(throughput), log(intensity), market.clip(ratio, -3.0, 3.0))


def region_features(df: DataFrame, scalars: list[str], kind: str, kinds: list[str], spectrum: str) -> DataFrame:
    """Adds `features`: scalars, the kind as 0s and 1s, and four real and imaginary parts, padded with zeros."""
    pad = lambda part: F.slice(F.concat(F.transform(spectrum, lambda z: z[part]), F.array_repeat(F.lit(0.0), 4)), 1, 4)
    hot = F.array(*[F.when(F.col(kind) == k, 1.0).otherwise(0.0) for k in kinds])
    return df.withColumn("features", F.concat(F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scalars]), hot, pad("re"), pad("im")))


def project_intent(queries: DataFrame, prototypes: DataFrame, least: float) -> DataFrame:
    """(q, best, scores): cosines with all prototypes (name, v), taken in blocks, and the best one if it reaches `least`."""
    score = F.when(market.norm(F.col("v")) > 0, market.cosine(F.col("v"), F.col("_p"))).alias("s")
    s = in_blocks(prototypes.select("name", F.col("v").alias("_p")), "name", lambda p: queries.join(p, F.lit(True)).select("q", "name", score))
    best = s.groupBy("q").agg(F.max_by("name", F.struct("s", "name")).alias("_b"), F.max("s").alias("_m"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "s")))).alias("scores"))
    return best.select("q", F.when(F.col("_m") >= least, F.col("_b")).alias("best"), "scores")


def retrieve_window(near: DataFrame, n: int, log_energy: str, query_energy: str, window: float) -> DataFrame:
    """Of over-fetched neighbours (q, rank, ...), the first n within a window of log energy; the filter comes after the
    over-fetch's limit on purpose."""
    ok = near.where(F.abs(F.col(log_energy) - F.col(query_energy)) <= window)
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("rank") <= n)


def retrieved_confirmed(near: DataFrame, spec_a: str, spec_b: str, most: float) -> DataFrame:
    """Retrieved pairs whose spectra are near as well."""
    return near.where(market.norm(F.zip_with(F.col(spec_a), F.col(spec_b), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))) < most)
