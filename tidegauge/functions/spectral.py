"""Expressions over frequencies and spectra (arrays of STRUCT<re, im>)."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.market import let


def rationals(largest: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(1, largest + 1) for q in range(1, largest + 1) if gcd(p, q) == 1]


def dissonance(wi: Column, wj: Column, largest: int = 8) -> Column:
    """Least distance of one frequency to a small-integer multiple of the other; 0 if either is zero."""
    ratios = F.array(*[F.lit(p / q) for p, q in rationals(largest)])
    near = F.array_min(F.transform(ratios, lambda r: F.abs(wi - r * wj)))
    return F.when((F.abs(wi) < 1e-12) | (F.abs(wj) < 1e-12), 0.0).otherwise(near)


def ratio_label(x: Column, largest: int = 8) -> Column:
    """`p:q` of the nearest small ratio; the simpler one on ties."""
    options = F.array(*[F.struct(F.lit(p / q).alias("v"), F.lit(p + q).alias("size"), F.lit(f"{p}:{q}").alias("label")) for p, q in rationals(largest)])
    return F.array_min(F.transform(options, lambda o: F.struct(F.abs(x - o["v"]).alias("far"), o["size"].alias("size"), o["label"].alias("label"))))["label"]


def best_rational(x: Column, most: int = 8) -> Column:
    """STRUCT<p, q> of the last continued-fraction convergent of a positive number whose denominator is at most `most`."""
    start = F.struct(x.cast("double").alias("r"), F.lit(1.0).alias("p1"), F.lit(0.0).alias("p0"), F.lit(0.0).alias("q1"), F.lit(1.0).alias("q0"), F.lit(False).alias("done"))

    def step(s, _):
        a = F.floor(s["r"]).cast("double")
        p, q = a * s["p1"] + s["p0"], a * s["q1"] + s["q0"]
        over = s["done"] | (q > most)
        rest = s["r"] - a
        keep = lambda new, old: F.when(over, old).otherwise(new)
        return F.struct(keep(F.when(rest > 1e-9, 1.0 / rest).otherwise(F.lit(1e18)), s["r"]).alias("r"), keep(p, s["p1"]).alias("p1"), keep(s["p1"], s["p0"]).alias("p0"), keep(q, s["q1"]).alias("q1"), keep(s["q1"], s["q0"]).alias("q0"), (over | (rest <= 1e-9)).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step, lambda s: F.struct(s["p1"].cast("long").alias("p"), s["q1"].cast("long").alias("q")))


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def hurwitz_margin(spec: Column) -> Column:
    """Largest real part; the spectrum is stable below zero."""
    return F.array_max(F.transform(spec, lambda z: z["re"]))


def mode_quantities(alpha: Column, omega: Column) -> dict[str, Column]:
    w0 = F.hypot(alpha, omega)
    return {"omega0": w0, "zeta": F.when(w0 > 0, -alpha / w0).otherwise(0.0), "hertz": omega / (2 * 3.141592653589793)}


def invariants(spec: Column, k: int) -> dict[str, Column]:
    """Radius, slow and oscillating counts, and the k largest values, padded with zeros."""
    ranked = F.reverse(F.array_sort(F.transform(spec, lambda z: F.struct(magnitude(z).alias("m"), z["re"].alias("re"), z["im"].alias("im")))))
    top = F.slice(F.concat(ranked, F.array_repeat(F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), k)), 1, k)
    return {
        "radius": F.coalesce(F.array_max(F.transform(spec, magnitude)), F.lit(0.0)), "n_slow": F.size(F.filter(spec, lambda z: magnitude(z) > 0.9)), "n_oscillating": F.size(F.filter(spec, lambda z: F.abs(z["im"]) > 0.1)),
        "top_re": F.transform(top, lambda z: z["re"]), "top_im": F.transform(top, lambda z: z["im"]),
    }


def spectral_entropy(amplitudes: Column, k: int) -> Column:
    """Entropy of the amplitudes as shares, over that of k equal ones."""
    def of(total: Column) -> Column:
        terms = F.transform(amplitudes, lambda a: F.when(a > 0, -(a / total) * F.ln(a / total)).otherwise(0.0))
        return F.when(total > 0, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.ln(F.lit(float(k)))).otherwise(0.0)

    return let(F.aggregate(amplitudes, F.lit(0.0), lambda s, x: s + x), of)


def resonance(a: Column, b: Column, k: int = 5) -> Column:
    """1 / (1 + least distance) between the first k frequencies of two spectra."""
    far = F.array_min(F.flatten(F.transform(F.slice(a, 1, k), lambda x: F.transform(F.slice(b, 1, k), lambda y: F.abs(x - y)))))
    return 1.0 / (1.0 + far)


def scale_spectrum(spec: Column, factor: Column) -> Column:
    return F.zip_with(spec, factor, lambda z, f: F.struct((z["re"] * f).alias("re"), (z["im"] * f).alias("im")))


def collapse_safe(frequencies: Column, least: float) -> Column:
    """Whether no two different values are nearer than `least`."""
    pairs = F.transform(frequencies, lambda x, i: F.exists(F.transform(frequencies, lambda y, j: (j > i) & (F.abs(x - y) < least)), lambda b: b))
    return ~F.exists(pairs, lambda b: b)


def von_mises(amplitude: Column, theta: Column, kappa: float) -> Column:
    return amplitude * F.exp(kappa * (F.cos(theta) - 1.0))


def phase_risk(gap: Column, consonance: Column, adjacent: Column) -> Column:
    raw = 0.4 * (1 - gap) + 0.35 * (1 - consonance) + 0.25 / (1 + 10 * adjacent)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def gap_regime(first: Column, second: Column) -> dict[str, Column]:
    gap = F.when(F.abs(first) > 1e-12, (first - second) / first).otherwise(0.0)
    return {"gap": gap, "regime": F.when(gap > 0.5, "separated").when(gap > 0.2, "moderate").otherwise("clustered"), "mixing": F.exp(-5.0 * gap)}


def trust_score(gap: Column, error: Column, drift: Column, condition: Column, gamma: float = 0.1, eta: float = 1.0, drift_max: float = 1.0, condition_max: float = 1e8) -> Column:
    """Product of four gates: a clear gap, a small error, little drift, a sound condition."""
    gate = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return gate(gap / gamma) * gate(1 - error / eta) * gate(1 - drift / drift_max) * gate(1 - F.log10(F.greatest(condition, F.lit(1.0))) / F.log10(F.lit(condition_max)))
