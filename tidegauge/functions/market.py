"""Market expressions: regimes, scores, decays, array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def regime_id(vol: Column) -> Column:
    return F.when(vol < 0.02, 0).when(vol < 0.05, 1).otherwise(2)


def regime_confidence(vol: Column) -> Column:
    raw = F.when(vol < 0.02, 1.0 - vol / 0.02).when(vol < 0.05, 1.0 - F.abs(vol - 0.035) / 0.015).otherwise(F.least(F.lit(1.0), vol / 0.05 - 1.0))
    return clip(raw, 0.1, 1.0)


def regime_scalars(vol_short: Column, vol_long: Column, trend: Column, duration: Column) -> dict[str, Column]:
    """alpha (mean reversion), beta (reaction to volatility) and stability of a regime."""
    return {
        "alpha": F.greatest(F.lit(0.1), 1.0 - F.abs(trend) + vol_short), "beta": F.greatest(F.lit(0.01), 0.1 * vol_short / F.greatest(vol_long, F.lit(1e-10))),
        "stability": F.least(F.lit(1.0), duration / (30.0 + 100.0 * vol_short)),
    }


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def linearity_score(features: Column) -> Column:
    """Population variance over the largest absolute value, at most 1."""
    m, squares = mean_of(features), mean_of(F.transform(features, lambda x: x * x))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), squares - m * m) / (F.array_max(F.transform(features, lambda x: F.abs(x))) + 1e-10))


def recommend(risk: Column, consonance: Column) -> Column:
    return F.when(risk > 0.7, "exit").when(risk > 0.4, "reduce").when(consonance > 0.7, "increase").otherwise("hold")


def enhance_score(base: Column, graph: Column, direction: Column, confidence: Column, alpha: float = 0.6, beta: float = 0.25, gamma: float = 0.15) -> Column:
    return clip(alpha * base + beta * F.tanh(graph) + gamma * direction * confidence, -1.0, 1.0)


def weighted_energy(b: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(b, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once for a row even where `use` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_decay(ts: Column, now: Column, tau_hours: float) -> Column:
    age = (micros(now) - micros(ts)) / 3.6e9
    return F.exp(-F.greatest(age, F.lit(0.0)) / tau_hours)


def half_life_decay(ts: Column, now: Column, days: float = 7.0) -> Column:
    age = (micros(now) - micros(ts)) / 8.64e10
    return F.exp(-0.6931471805599453 * F.greatest(age, F.lit(0.0)) / days)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def gram_schmidt_step(v: Column, unit: Column) -> Column:
    """What is left of v outside the direction of a unit vector."""
    return let(dot(v, unit), lambda d: F.zip_with(v, unit, lambda x, u: x - d * u))


def translate(v: Column, a: Column, b: Column) -> Column:
    return F.zip_with(v, F.zip_with(b, a, lambda x, y: x - y), lambda x, d: x + d)


def argmax_label(scores: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def window_vector(features: Column, n_features: int, dim: int) -> Column:
    """Each feature spread over its block of dimensions as f * cos(0.1 j), then normalised."""
    block = max(1, dim // n_features)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get(features, F.floor(i / block).cast("int")), F.lit(0.0)) * F.cos(0.1 * (i % block)))
    return normalized(raw)
