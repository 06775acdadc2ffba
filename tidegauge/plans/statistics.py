"""Statistics, sweeps, spectra and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import market, spectral
from tidegauge.operators import joins
from tidegauge.operators import statistics as st
from tidegauge.plans.registry import query, table


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_LONG = "long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(f"WITH {_LONG}, p AS (SELECT a.label, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, i::INT AS i, j::INT AS j, round(c + CASE WHEN n <= 64 AND i = j THEN 1e-6::DOUBLE ELSE 0 END, 6) AS cov FROM p JOIN n USING (label)")
def d04_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = st.source_profile(vectors(spark, sf_dir), "label", "v").withColumn("d", F.sqrt(F.size("cov").cast("double")).cast("int"))
    return prof.select("label", "n", "d", F.posexplode("cov").alias("k", "c")).select("label", "n", F.floor(F.col("k") / F.col("d")).cast("int").alias("i"), (F.col("k") % F.col("d")).alias("j"), F.round("c", 6).alias("cov"))


@query()
def d05_spectral_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.spectral_summary(st.source_profile(vectors(spark, sf_dir), "label", "v"), "label", 5)


@query()
def d06_fit_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of each vector from its first half."""
    half = F.floor(F.size("v") / 2).cast("int")
    rows = vectors(spark, sf_dir).select("label", F.slice("v", F.lit(1), half).alias("x"), F.slice("v", half + 1, F.size("v") - half).alias("y"))
    return st.fit_linear(rows, ["label"], "x", "y").select("label", "n", "weights", "r2")


@query()
def d07_fit_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of each vector from its first half, by label, and its lift."""
    half = F.floor(F.size("v") / 2).cast("int")
    rows = vectors(spark, sf_dir).select("vec_id", "label", F.slice("v", F.lit(1), half).alias("x"), F.slice("v", half + 1, F.size("v") - half).alias("y"))
    return st.apply_lift(rows, st.fit_lift(rows, ["label"], "x", "y"), ["label"], "x").select("vec_id", "label", "lifted")


@query("""WITH p AS (SELECT user_id, value / 500 AS x, lead(value / 500) OVER (PARTITION BY user_id ORDER BY ts) AS y FROM events)
    SELECT user_id, count(*) AS m, round(avg(x), 6) AS g01, round(avg(x * x), 6) AS g11, round(avg(x * y), 6) AS a11 FROM p WHERE y IS NOT NULL GROUP BY 1""")
def d09_edmd_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram sums behind the EDMD fit."""
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500).alias("x"))
    pairs = st.edmd_pairs(x, "user_id", "ts", "x", 1)
    return pairs.groupBy("user_id").agg(F.count("*").alias("m"), F.round(F.avg(F.col("psi")[1]), 6).alias("g01"), F.round(F.avg(F.col("psi")[1] * F.col("psi")[1]), 6).alias("g11"), F.round(F.avg(F.col("psi")[1] * F.col("psi_next")[1]), 6).alias("a11"))


@query()
def d09_edmd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500).alias("x"))
    return st.edmd_fit(x, "user_id", "ts", "x", 2)


@query()
def e14_windowed_edmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500).alias("x"))
    return st.windowed_edmd(x, "user_id", "ts", "x", 20, 10)


@query()
def e14_reduced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's windows have in common."""
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500, (F.col("event_id") % 7) / 7.0).alias("x"))
    return st.reduce_windows(st.windowed_edmd(x, "user_id", "ts", "x", 40), "user_id")


@query("""SELECT event_type, count(*) AS trials, count(*) FILTER (value > 100) AS successes, round(1 - count(*) FILTER (value > 100) / count(*), 6) AS failure_rate, round(avg(value) FILTER (value > 100), 6) AS mean,
    round(quantile_cont(value, 0.5::DOUBLE) FILTER (value > 100), 6) AS median, round(quantile_cont(value, 0.75::DOUBLE) FILTER (value > 100), 6) AS p75, round(quantile_cont(value, 0.95::DOUBLE) FILTER (value > 100), 6) AS p95, min(value) FILTER (value > 100) AS least, max(value) FILTER (value > 100) AS most FROM events GROUP BY 1""")
def d16_trial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.trial_stats(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") > 100)
    return s.select("event_type", "trials", "successes", *r6("failure_rate", "mean", "median", "p75", "p95"), "least", "most")


@query("SELECT l_linenumber, round(avg(abs(l_discount - 0.05::DOUBLE)), 6) AS mean_error, round(max(abs(l_discount - 0.05::DOUBLE)), 6) AS max_error FROM lineitem GROUP BY 1")
def d18_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, _ = st.sweep_summary(table(spark, sf_dir, "lineitem").withColumn("err", F.col("l_discount") - 0.05), "l_linenumber", "err")
    return by.select("l_linenumber", *r6("mean_error", "max_error"))


@query("SELECT l_returnflag, round(-sum((l_discount - 0.05::DOUBLE) * l_quantity) / sum(l_quantity * l_quantity), 9) AS a FROM lineitem GROUP BY 1")
def d19_fit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("e"), F.col("l_quantity").alias("x"))
    return st.fit_ratio(li, "x", "e", ["l_returnflag"]).select("l_returnflag", F.round("a", 9).alias("a"))


_CV = """s AS (SELECT l_linenumber AS g, l_quantity AS x, l_discount - 0.03::DOUBLE AS e FROM lineitem), p AS (SELECT DISTINCT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM s) a, (SELECT DISTINCT g FROM s) b WHERE a.g < b.g),
    f AS (SELECT g1, g2, -sum(e * x) / sum(x * x) AS a FROM p, s WHERE s.g <> g1 AND s.g <> g2 GROUP BY ALL)"""


@query(f"WITH {_CV} SELECT g1, g2, round(a, 9) AS a, round(avg(abs(e + a * x)), 6) AS mean_error, round(max(abs(e + a * x)), 6) AS max_error FROM f JOIN s ON s.g = g1 OR s.g = g2 GROUP BY g1, g2, a")
def d20_leave_two_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_discount") - 0.03).alias("e"), F.col("l_quantity").alias("x"))
    out = st.leave_n_out(li, "l_linenumber", "x", "e", 2)
    return out.select(F.col("groups")[0].alias("g1"), F.col("groups")[1].alias("g2"), F.round("a", 9).alias("a"), *r6("mean_error", "max_error"))


@query(f"WITH {_CV} SELECT round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS std, round(min(a), 9) AS least, round(max(a), 9) AS most, (max(a) - min(a)) / abs(avg(a)) * 100 < 5 AS stable FROM f")
def d21_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_discount") - 0.03).alias("e"), F.col("l_quantity").alias("x"))
    return st.cv_summary(st.leave_n_out(li, "l_linenumber", "x", "e", 2)).select(*[F.round(c, 9).alias(c) for c in ("mean", "std", "least", "most")], "stable")


@query("SELECT p_partkey, p_retailprice, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice <= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size < p.p_size))")
def d32_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.skyline(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice", "p_size")


_U = "(1 + 0.1::DOUBLE * (2 * (('0x' || substr(md5(p_partkey || ':' || k || ':' || '{0}' || ':' || 0), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1))"


@query(f"""WITH d AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS r, 0.5::DOUBLE AS l, 2.0::DOUBLE AS c FROM part), x AS (SELECT p_partkey, l, c, r * {_U.format('r')} AS rr, l * {_U.format('l')} AS ll, c * {_U.format('c')} AS cc FROM d, range(0, 20) t(k))
    SELECT p_partkey, round(avg((rr / (2 * ll) < 1 / sqrt(ll * cc))::INT), 6) AS underdamped, round(stddev_pop(1 / sqrt(ll * cc)), 6) AS spread, round(max(abs(1 / sqrt(ll * cc) / (1 / sqrt(l * c)) - 1)), 6) AS worst FROM x GROUP BY 1""")
def d33_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("r"), F.lit(0.5).alias("l"), F.lit(2.0).alias("c"))
    return st.monte_carlo(d, "p_partkey", "r", "l", "c", 0.1, 20).select("p_partkey", *r6("underdamped", "spread", "worst"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sigma, round(stddev_pop(value) / sqrt(count(*)), 6) AS se_mu, round(stddev_pop(value) / sqrt(2 * count(*)), 6) AS se_sigma, stddev_pop(value) / sqrt(count(*)) < 12 AND stddev_pop(value) / sqrt(2 * count(*)) < 12 AS promoted FROM events GROUP BY 1")
def d34_gaussian_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.gaussian_mle(table(spark, sf_dir, "events"), ["user_id"], "value", 12.0).select("user_id", "n", *r6("mu", "sigma", "se_mu", "se_sigma"), "promoted")


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), t AS (SELECT vec_id, a, list_sum(a) AS t FROM a) SELECT vec_id, round(list_sum(list_transform(a, lambda x: CASE WHEN x > 0 THEN -(x / t) * ln(x / t) ELSE 0 END)) / ln(64), 6) AS entropy FROM t")
def d35_spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(spectral.spectral_entropy(F.transform("v", lambda x: F.abs(x)), 64), 6).alias("entropy"))


@query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def d36_fit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.fit_scaling(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", *r6("slope", "intercept"))


@query("WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def d49_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rank_corr(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", *r6("rho"))


@query("WITH s AS (SELECT least(floor(least(n_chars / 20000.0::DOUBLE, 0.999::DOUBLE) * 10), 9)::INT AS bin, least(n_chars / 20000.0::DOUBLE, 0.999::DOUBLE) AS s, toxic FROM documents JOIN labels USING (doc_id)) SELECT bin, count(*) AS n, round(avg(toxic), 6) AS rate, round(avg(s), 6) AS mean_score FROM s GROUP BY 1")
def d51_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.least(F.col("n_chars") / 20000.0, F.lit(0.999)).alias("s"), "toxic")
    return st.calibration(s, "s", "toxic", 10).select("bin", "n", F.round("rate", 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS converged, round(avg((value < 250)::INT), 6) AS stable_fraction, min(value) AS least_frequency, max(value) AS most_frequency FROM events GROUP BY 1")
def d15_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = st.scan_report(table(spark, sf_dir, "events"), F.col("value") > 10, F.col("value") < 250, "event_type", "value")
    return r.select("event_type", "n", "converged", *r6("stable_fraction"), "least_frequency", "most_frequency")


@query("WITH e AS (SELECT vec_id AS id, list_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s, label FROM embeddings WHERE vec_id < 100) SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(range(1, 65), lambda k: abs(a.s[k] - b.s[k]))) / 64, 6) AS distance FROM e a JOIN e b ON a.id < b.id AND a.label = b.label".replace(" WHERE vec_id < 100", ""))
def c05_spectrum_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.transform("v", lambda x: F.abs(x)).alias("s"))
    return joins.spectrum_pairs(e, "id", "s", "label", digits=6)


@query("WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q) SELECT q, id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY c DESC, id)::INT AS rank FROM s QUALIFY rank <= 5")
def f04_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to a fixed set of queries."""
    v = vectors(spark, sf_dir)
    return joins.cosine_top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "v"), v.select(F.col("vec_id").alias("id"), "v"), 5).select("q", "id", *r6("similarity"), "rank")


@query("WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, sqrt((embedding[1]::DOUBLE - v[1]::DOUBLE)**2 + (embedding[2]::DOUBLE - v[2]::DOUBLE)**2 + (embedding[3]::DOUBLE - v[3]::DOUBLE)**2) AS d FROM embeddings, q) SELECT q, id, round(d, 6) AS distance, row_number() OVER (PARTITION BY q ORDER BY d, id)::INT AS rank FROM s QUALIFY rank <= 5")
def f02_nearest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), *[F.col("v")[i].alias(f"k{i + 1}") for i in range(3)])
    return joins.nearest_keys(k.where("id % 100 = 0").withColumnRenamed("id", "q"), k, 5).select("q", "id", *r6("distance"), "rank")


@query()
def f05_retrieval_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return joins.retrieval_chain(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "v"), v.select(F.col("vec_id").alias("id"), "v"), 5, 3)


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rank FROM events QUALIFY rank <= 10")
def f01_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.relations import top_k

    return top_k(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "value", 10, ["event_type"], ["event_id"])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS mirrored FROM embeddings")
def h50_vector_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(market.norm(F.col("v")), 6).alias("norm"), F.round(market.cosine(F.col("v"), F.reverse("v")), 6).alias("mirrored"))


_RAT = ", ".join(f"({p}, {q})" for p, q in spectral.rationals(8))


@query(f"WITH r(p, q) AS (VALUES {_RAT}), x AS (SELECT p_partkey, p_size::DOUBLE AS wi, (p_partkey % 97 + 1)::DOUBLE AS wj FROM part) SELECT p_partkey, round(min(abs(wi - p / q::DOUBLE * wj)), 6) AS tau, arg_min(p || ':' || q, (abs(wi / wj - p / q::DOUBLE), p + q, p || ':' || q)) AS ratio FROM x, r GROUP BY 1")
def h24_dissonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissonance and the nearest small ratio (H-24, H-25)."""
    wi, wj = F.col("p_size").cast("double"), (F.col("p_partkey") % 97 + 1).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(spectral.dissonance(wi, wj, 8), 6).alias("tau"), spectral.ratio_label(wi / wj, 8).alias("ratio"))


@query("SELECT vec_id, round(sqrt(a * a + w * w), 6) AS omega0, round(-a / sqrt(a * a + w * w), 6) AS zeta, round(w / (2 * pi()), 6) AS hertz FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS w FROM embeddings)")
def h43_mode_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spectral.mode_quantities(F.col("v")[0], F.col("v")[1])
    return vectors(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(k) for k, c in q.items()])


@query("WITH x AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS g, abs(embedding[2]::DOUBLE) AS c, abs(embedding[3]::DOUBLE) AS j FROM embeddings) SELECT vec_id, round(least(1, greatest(0, 0.4::DOUBLE * (1 - g) + 0.35::DOUBLE * (1 - c) + 0.25::DOUBLE / (1 + 10 * j))), 6) AS risk FROM x")
def h48_phase_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [F.abs(F.col("v")[i]) for i in range(3)]
    return vectors(spark, sf_dir).select("vec_id", F.round(spectral.phase_risk(*a), 6).alias("risk"))


@query("WITH g AS (SELECT p_partkey, 1.0::DOUBLE AS l, 0.001::DOUBLE * (p_size + 1) AS c, p_retailprice / 100 AS r FROM part), w AS (SELECT *, 100.0::DOUBLE * (k + 1) AS w FROM g, range(0, 10) t(k)) SELECT p_partkey, k::INT AS k, round(r / sqrt(r * r + (w * l - 1 / (w * c)) ** 2), 6) AS gain FROM w")
def h61_frequency_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass gain of series RLC designs on a frequency grid."""
    from tidegauge.operators.relations import frequency_response

    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("r"), F.lit(1.0).alias("l"), (0.001 * (F.col("p_size") + 1)).alias("c"))
    return frequency_response(d, 10, 100.0).select("p_partkey", "k", *r6("gain"))


@query("WITH m AS (SELECT s_suppkey, 3 + s_suppkey % 5 AS h, 0.3::DOUBLE + (s_suppkey % 7) / 10.0::DOUBLE AS pm FROM supplier), z AS (SELECT * FROM m, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2)) t(zeta)), d AS (SELECT *, asin(least(pm / 2.0::DOUBLE, 1)) AS d0 FROM z), t AS (SELECT *, acos(least(1, greatest(-1, (pi() - 2 * d0) * sin(d0) - cos(d0)))) AS dc FROM d) SELECT s_suppkey, zeta, round(sqrt(2 * (2 * h / (2 * pi() * 60)) * (dc - d0) / pm) / (1 - 1.51::DOUBLE * zeta), 6) AS clearing FROM t")
def h45_clearing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.relations import clearing_time

    m = table(spark, sf_dir, "supplier").select("s_suppkey", (3 + F.col("s_suppkey") % 5).alias("h"), (0.3 + (F.col("s_suppkey") % 7) / 10.0).alias("p_m"), F.lit(2.0).alias("p_max"))
    return clearing_time(m, [0.0, 0.05, 0.1, 0.2], 1.51).select("s_suppkey", "zeta", F.round("clearing", 6).alias("clearing"))
