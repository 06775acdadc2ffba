"""Pluggable predictors with shifted gates, and scoring in batches, against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import learning, regimes


def test_predictors_with_shifts(spark):
    df = spark.createDataFrame([(1, 0.5, [1.0, 0.5], [0.2, 0.8], 1), (2, -1.0, [0.0, 0.0], [1.0, 0.0], 9)], "i int, x double, cal array<double>, reg array<double>, t int")
    cal, reg = [[0.1, 0.2, 0.3], [1.0, 0.0, -1.0]], [[0.5, 0.0, 0.0], [0.0, 0.0, 2.0]]
    predictors = {"long": lambda: {"value": F.col("x"), "confidence": F.lit(0.9)}, "medium": lambda: {"value": F.col("x") * 2, "linearity": F.lit(0.4)}, "short": lambda: {"value": -F.col("x"), "gap": F.lit(0.7)}}
    got = {r.i: r for r in regimes.mix_predictors(df, predictors, calendar="cal", calendar_shift=cal, regime="reg", regime_shift=reg, tongues="t").collect()}
    for i, x, c, g, t in df.collect():
        logits = [base + sum(a * m[h] for a, m in zip(c, cal)) + sum(a * m[h] for a, m in zip(g, reg)) for h, base in enumerate((0.9, -0.2, 0.21))]
        w = [math.exp(z) / sum(map(math.exp, logits)) for z in logits]
        assert np.allclose(got[i].weights, w) and got[i].dominant == regimes.HORIZONS[int(np.argmax(w))]
        assert got[i].blended == pytest.approx(sum(a * b for a, b in zip(w, (x, 2 * x, -x))) * max(0.0, 1 - 0.15 * t))
    assert got[2].blended == 0 and "_logits" not in regimes.mix_predictors(df, predictors).columns


def test_scores_of_batches(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else 2.0) for i in range(50)], "i int, a double, b double").repartition(3)
    got = {r.i: r.score for r in learning.score_batches(df, ["a", "b"], lambda m: m[:, 0] * m[:, 1]).collect()}
    assert all(got[i] == 2.0 * i for i in range(50) if i != 3) and (got[3] is None or math.isnan(got[3]))
    assert learning.score_batches(df.limit(0), ["a", "b"], lambda m: m.sum(axis=1)).count() == 0
