"""Further queries: similarity joins, modes, horizons, sections, libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import market
from tidegauge.functions import text as tx
from tidegauge.operators import calendar as cal_ops
from tidegauge.operators import graph, joins, learning, regimes, relations
from tidegauge.plans.calendar import _DAYS, _EVENTS, days
from tidegauge.plans.registry import query, table
from tidegauge.plans.statistics import _RAT
from tidegauge.plans.text import _DIMS, _lang_dims


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH s AS (SELECT vec_id, label, list_distinct(list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.05)) AS dims FROM embeddings), n AS (SELECT * FROM s WHERE len(dims) > 0)
    SELECT a.vec_id AS a, b.vec_id AS b, round(len(list_intersect(a.dims, b.dims)) / sqrt(len(a.dims)::DOUBLE * len(b.dims)), 6) AS similarity FROM n a JOIN n b ON a.label < b.label WHERE len(list_intersect(a.dims, b.dims)) / sqrt(len(a.dims)::DOUBLE * len(b.dims)) >= 0.6::DOUBLE""")
def c03_find_universals(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("e", i) > F.lit(0.05).cast("float"))
    p = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding")).select(F.col("vec_id").alias("pattern_id"), F.col("label").alias("dimension"), places.alias("dims"))
    return joins.find_universals(p, 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


_MODES = "modes AS (SELECT vec_id, i AS idx, embedding[i * 2 + 1]::DOUBLE AS alpha, abs(embedding[i * 2 + 2]::DOUBLE) + 0.01::DOUBLE AS omega FROM embeddings, range(0, 32) t(i))"


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.cast("long").alias("idx"), F.get("v", i * 2).alias("alpha"), (F.abs(F.get("v", i * 2 + 1)) + 0.01).alias("omega")))
    return vectors(spark, sf_dir).select("vec_id", F.inline(parts))


@query(f"""WITH {_MODES}, r(p, q) AS (VALUES {_RAT}), h AS (SELECT vec_id, sum(tau) AS e_harm FROM (SELECT x.vec_id, x.idx, y.idx, min(abs(x.omega - p / q::DOUBLE * y.omega)) AS tau FROM modes x JOIN modes y ON x.vec_id = y.vec_id AND x.idx < y.idx, r GROUP BY ALL) GROUP BY 1)
    SELECT vec_id, round(sum(greatest(alpha, 0) ** 2), 6) AS e_stab, round(sum(1 / (1 + abs(alpha))), 6) AS e_damp, round(sum((omega - 0.1::DOUBLE) ** 2), 6) AS e_freq, round(any_value(e_harm), 6) AS e_harm FROM modes JOIN h USING (vec_id) GROUP BY 1""")
def h44_spectral_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regimes.spectral_energy(_modes(spark, sf_dir), "vec_id", 0.1)
    return e.select("vec_id", *[F.round(c, 6).alias(c) for c in ("e_stab", "e_damp", "e_freq", "e_harm")])


@query()
def h56_basin_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.basin_gates(_modes(spark, sf_dir), "vec_id", 0.05, 0.01)


@query(f"WITH {_MODES}, c AS (SELECT vec_id, (least(floor(omega / 0.5::DOUBLE * 4), 3) * 4 + least(floor(abs(alpha) / 0.5::DOUBLE * 4), 3))::INT AS dim, sum(omega) AS m FROM modes GROUP BY ALL) SELECT vec_id, dim, round(m / sum(m) OVER (PARTITION BY vec_id), 6) AS weight FROM c")
def h55_frequency_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _modes(spark, sf_dir).select("vec_id", F.col("omega").alias("frequency"), F.col("alpha").alias("decay"), F.col("omega").alias("magnitude"))
    return regimes.frequency_signature(m, "vec_id", 16, 0.5, 0.5).select("vec_id", "dim", F.round("weight", 6).alias("weight"))


@query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), e AS (SELECT *, exp(a) + exp(b) + exp(c) AS t FROM x)
    SELECT vec_id, round((exp(a) * a + exp(b) * b + exp(c) * c) / t, 6) AS blended, CASE WHEN a >= b AND a >= c THEN 'long' WHEN b >= c THEN 'medium' ELSE 'short' END AS dominant FROM e""")
def h29_mix_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir).withColumn("x", F.slice("v", 1, 3))
    return regimes.mix_horizons(x, "x", "x").select("vec_id", F.round("blended", 6).alias("blended"), "dominant")


@query(f"""WITH {_DAYS}, {_EVENTS}, r(p, q) AS (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)),
    x AS (SELECT a.d, a.c AS i, b.c AS j, p, q, q * a.theta - p * b.theta + pi() AS z, 0.3::DOUBLE ** q * 2 / (p + q) AS width FROM phased a JOIN phased b ON a.d = b.d AND a.c < b.c AND a.amp > 0.05::DOUBLE AND b.amp > 0.05::DOUBLE, r)
    SELECT d, i::INT AS i, j::INT AS j, p::INT AS p, q::INT AS q, round(width, 6) AS width FROM x WHERE abs((z % (2 * pi())) + CASE WHEN z % (2 * pi()) < 0 THEN 2 * pi() ELSE 0 END - pi()) <= width""")
def h27_detect_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.detect_resonance(cal_ops.phases(days(spark, sf_dir)), "d", 0.3, 3).select("d", "i", "j", "p", "q", F.round("width", 6).alias("width"))


@query()
def d43_section_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.section_profile(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def d11_observer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.length("text") / 1000.0, F.size(tx.tokens(F.col("text"))) / 100.0).alias("v"))
    return learning.observer_state(turns, "conv_id", "turn", "v")


@query()
def d39_pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.pca_project(vectors(spark, sf_dir), "v", 2).select("vec_id", "projected")


@query()
def e15_spectral_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500).alias("x"))
    return learning.spectral_robustness(x, "user_id", "ts", "x", 4)


@query("""WITH e AS (SELECT doc_id AS ord, source AS paper_id, lang AS domain, md5(regexp_replace(text, '\\s+', '', 'g')) AS c FROM documents) SELECT c AS canonical, count(DISTINCT domain) AS n_domains, count(DISTINCT paper_id) AS n_papers, min(ord) AS first FROM e GROUP BY 1""")
def d27_build_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents stand in for equations; the library's entries are told by their digests."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("paper_id"), F.col("lang").alias("domain"), F.col("text").alias("latex"))
    return relations.build_library(e).select(F.md5("canonical").alias("canonical"), F.size("domains").cast("long").alias("n_domains"), F.size("papers").cast("long").alias("n_papers"), "first")


@query(f"WITH {_DIMS} SELECT lang AS domain, count(DISTINCT dim) AS n FROM dims GROUP BY 1")
def d40_domain_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lang_dims(spark, sf_dir).groupBy(F.col("lang").alias("domain")).agg(F.countDistinct("dim").alias("n"))


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_discount AS a, l_tax AS b, l_quantity / 50 AS c FROM lineitem), m AS (SELECT max(a) AS a, max(b) AS b, max(c) AS c FROM e), x AS (SELECT src, dst, e.a / m.a + e.b / m.b + e.c / m.c AS cost FROM e, m), y AS (SELECT * FROM x UNION ALL SELECT dst, src, cost FROM x) SELECT src, dst, round(min(cost), 6) AS cost FROM y GROUP BY ALL""")
def h47_edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("curvature"), F.col("l_tax").alias("interval"), (F.col("l_quantity") / 50).alias("risk"))
    return graph.edge_costs(e, normalize=True).select("src", "dst", F.round("cost", 6).alias("cost"))


@query("WITH q AS (SELECT label AS q, list(embedding::DOUBLE[] ORDER BY vec_id)[1] AS v FROM embeddings GROUP BY 1), s AS (SELECT e.vec_id AS id, q.q, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS c FROM embeddings e, q) SELECT id, CASE WHEN max(c) >= 0.5::DOUBLE THEN arg_max(q, c) END::INT AS best FROM s GROUP BY 1")
def f10_project_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first vector of every label as prototypes."""
    v = vectors(spark, sf_dir)
    protos = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).select(F.col("label").alias("name"), "v")
    return regimes.project_intent(v.select(F.col("vec_id").alias("q"), "v"), protos, 0.5).select(F.col("q").alias("id"), F.col("best").cast("int").alias("best"))


@query("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), y AS (SELECT vec_id, list_transform(range(0, 20), lambda i: v[(i // 2 + 1)::INT] * cos(0.1::DOUBLE * (i % 2))) AS w FROM x) SELECT vec_id, round(w[1] / sqrt(list_sum(list_transform(w, lambda z: z * z))), 6) AS first, round(w[20] / sqrt(list_sum(list_transform(w, lambda z: z * z))), 6) AS last FROM y")
def h53_window_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = market.window_vector(F.slice("v", 1, 10), 10, 20)
    return vectors(spark, sf_dir).select("vec_id", w.alias("w")).select("vec_id", F.round(F.col("w")[0], 6).alias("first"), F.round(F.col("w")[19], 6).alias("last"))


@query("SELECT round(avg(abs(l_discount - 0.05::DOUBLE)), 6) AS mean_error, round(max(abs(l_discount - 0.05::DOUBLE)), 6) AS max_error, round(avg(l_tax / (l_discount + 1)), 6) AS mean_ratio FROM lineitem")
def d22_bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("e"), (F.col("l_tax") / (F.col("l_discount") + 1)).alias("r"))
    return relations.bench_summary(li, "e", "r").select(*[F.round(c, 6).alias(c) for c in ("mean_error", "max_error", "mean_ratio")])


@query("SELECT p_partkey AS module, p_size AS complexity FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def f06_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.hotspots(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module"), F.col("p_size").alias("complexity")), 20)


@query()
def e18_compare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' monthly order values as profiles, compared pair by pair."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy("c_mktsegment", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("x"))
    p = m.groupBy("c_mktsegment").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "x"))), lambda a: a["x"]).alias("profile"))
    return relations.compare_domains(p, "c_mktsegment", "profile", 24)


@query()
def h60_repo_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.repo_page(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def h52_article_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed article vectors, scaled by validity; no bias is known for the sources here."""
    from tidegauge.functions import embedding

    d = {k: c for k, c in tx.densities(F.col("text")).items()}
    docs = table(spark, sf_dir, "documents").select("doc_id", embedding.hash_embed(F.col("text"), 64).alias("e"), (d["technical"] + d["citation"] - d["hype"]).alias("validity"))
    return docs.select("doc_id", embedding.article_vector(F.col("e"), F.col("validity"), F.array_repeat(F.lit(0.0), 64), F.lit(1.0)).alias("v"))


@query()
def j05_regime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistent regimes of each user's values and their steps."""
    from pyspark.sql import Window

    from tidegauge.streaming.states import regime_events

    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("x"))
    step = F.coalesce(F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("ts")), F.lit(0.0))
    return regime_events(e.withColumn("v", F.array("x", step)), "user_id", "ts", "v")


@query()
def j09_reharmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained tracker over each user's values and their steps; returns are the values' changes."""
    from pyspark.sql import Window

    from tidegauge.streaming.folds import reharmonize

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("x"))
    step = F.coalesce(F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(0.0))
    return reharmonize(e.withColumn("step", step).withColumn("v", F.array("x", "step")), "user_id", "event_id", "v", "step")


@query("""WITH e AS (SELECT user_id, event_id, value / 500 - 0.2::DOUBLE AS r, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM events),
    c AS (SELECT *, sum(r) OVER p AS cumulative, count(*) OVER p AS n, coalesce(var_samp(r) OVER p, 0) AS variance, avg(r) OVER p AS mean FROM e WINDOW p AS (PARTITION BY user_id, w ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, greatest(max(cumulative) OVER (PARTITION BY user_id, w ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) - cumulative AS down FROM c),
    d AS (SELECT *, max(down) OVER (PARTITION BY user_id, w ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS drawdown FROM k)
    SELECT user_id, event_id, CASE WHEN w > 0 THEN w END::INT AS window, CASE WHEN w > 0 THEN n END::INT AS returns, round(CASE WHEN w > 0 THEN cumulative END, 6) AS cumulative, round(CASE WHEN w > 0 THEN variance END, 6) AS variance,
        round(CASE WHEN w > 0 THEN drawdown END, 6) AS drawdown, round(CASE WHEN w > 0 THEN CASE WHEN n >= 3 THEN mean / sqrt(greatest(variance, 1e-15::DOUBLE)) ELSE 0 END END, 6) AS sharpe FROM d""")
def j09_profit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's last stage on its own: each user's returns from one purchase to the next."""
    from tidegauge.streaming.folds import ProfitWindows, fold

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500 - 0.2).alias("r"), (F.col("event_type") == "purchase").alias("bought"))
    told = fold(e, "user_id", "event_id", ProfitWindows("r", "bought", 3))
    return told.select("user_id", "event_id", "window", "returns", *[F.round(c, 6).alias(c) for c in ("cumulative", "variance", "drawdown", "sharpe")])


@query("""WITH RECURSIVE v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS x FROM embeddings),
    m AS (SELECT label, i, n, x, x AS m FROM v WHERE i = 1 UNION ALL SELECT v.label, v.i, v.n, v.x, list_transform(range(1, 65), lambda k: 0.95::DOUBLE * m.m[k] + 0.05::DOUBLE * v.x[k]) FROM v JOIN m ON v.label = m.label AND v.i = m.i + 1),
    d AS (SELECT label, i, n, m, list_transform(range(1, 65), lambda k: x[k] - m[k]) AS d FROM m)
    SELECT label, max(n) AS n, round(list_sum(arg_max(m, i)), 6) AS mean_sum, round(sum(0.05::DOUBLE * 0.95::DOUBLE ** (n - i) * list_sum(list_transform(d, lambda a: a * a))), 6) AS cov_trace, round(sum(0.05::DOUBLE * 0.95::DOUBLE ** (n - i) * list_sum(d) ** 2), 6) AS cov_sum FROM d GROUP BY label""")
def j04_running_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean and covariance of each label's vectors, told by their sums and the trace."""
    from tidegauge.operators.statistics import running_moments

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    told = running_moments(vectors(spark, sf_dir), "label", "vec_id", "v")
    trace = total(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("cov", k * 65)))
    return told.select("label", "n", F.round(total("mean"), 6).alias("mean_sum"), F.round(trace, 6).alias("cov_trace"), F.round(total("cov"), 6).alias("cov_sum"))


@query()
def j08_bootstrap_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.statistics import bootstrap_spectrum

    x = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 500, (F.col("event_id") % 7) / 7.0).alias("x"))
    return bootstrap_spectrum(x, "user_id", "ts", "x")
