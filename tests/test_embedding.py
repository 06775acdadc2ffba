import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidegauge.functions import embedding
from tidegauge.operators import statistics as st


def test_hash_embedding_equals_the_definition(spark):
    texts = ["", "abc", "größe"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embedding.hash_embed(F.col("t"), 50).alias("v")).collect()
    for r in got:
        v = np.zeros(50)
        for i, ch in enumerate(r.t.encode()):
            h = int(hashlib.md5(f"{ch}_{i}".encode()).hexdigest(), 16)
            v[h % 50] += 1.0 if (h // 50) % 2 == 0 else -1.0
        n = np.linalg.norm(v)
        assert np.allclose(r.v, v / n if n else v)


def test_vectors_of_articles_and_intents(spark):
    one = F.array(F.lit(1.0), F.lit(0.0))
    r = spark.range(1).select(embedding.article_vector(one, F.lit(0.5), F.array(F.lit(0.5), F.lit(0.0)), F.lit(0.5)).alias("a"), embedding.intent_vector(one, F.array(F.lit(0.0), F.lit(2.0))).alias("i"), embedding.patch_distance(one, one, F.lit(1.0), F.lit(1.0), F.lit(2), F.lit(2)).alias("d")).first()
    assert r.a == [0.25, 0.0] and np.allclose(r.i, [2**-0.5, 2**-0.5]) and r.d == 0.0


def test_weighted_fits_and_replicates(spark):
    rows = [(i, [float(i)], [2.0 * i + 1]) for i in range(30)] + [(100, [1.0], [50.0])]
    pairs = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    phases = spark.createDataFrame([(i, "fed", 0.0, 1.0) for i in range(30)] + [(100, "fed", 3.1, 0.5), (0, "holiday", 0.0, 1.0)], "k int, channel string, theta double, amplitude double")
    fit = {r.channel: r.weights for r in st.fit_calendar_lift(pairs, phases, "k", "x", "y").collect()}
    assert set(fit) == {"fed"} and np.allclose(fit["fed"], [1.0, 2.0], atol=0.6)
    series = spark.createDataFrame([("s", t, [float(0.9**t * np.cos(0.3 * t)), float(0.9**t * np.sin(0.3 * t))]) for t in range(70)], "s string, t int, x array<double>")
    got = st.bootstrap_spectrum(series, "s", "t", "x", width=40, stride=30, draws=4).collect()
    assert len(got) == 2 and all(abs(r.frequency - 0.3) < 1e-3 and abs(r.lead - 0.9) < 1e-3 for r in got) and all(r.low <= r.high for r in got)


def test_positions_never_start_over(spark):
    import hashlib

    text, dim = "aé " * 7000, 20
    want = [0.0] * dim
    for p, b in enumerate(text.encode()):
        h = int(hashlib.md5(f"{b}_{p}".encode()).hexdigest(), 16)
        want[h % dim] += 1 if h // dim % 2 == 0 else -1
    norm = sum(x * x for x in want) ** 0.5
    got = spark.createDataFrame([(text,)], "t string").select(embedding.hash_embed(F.col("t"), dim).alias("v")).first().v
    assert all(abs(g - w / norm) < 1e-12 for g, w in zip(got, want, strict=True))
