"""Queries over inputs which Spark derives from the tables: memories, modes, libraries and regions out of vectors and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import embedding, market, spectral, tables
from tidegauge.functions import text as tx
from tidegauge.operators import calendar as cal_ops
from tidegauge.operators import graph, joins, learning, regimes, relations
from tidegauge.operators import statistics as st
from tidegauge.operators.store import written
from tidegauge.plans.calendar import _DAYS, _EVENTS, days
from tidegauge.plans.registry import query, table
from tidegauge.plans.statistics import r6, vectors
from tidegauge.plans.text import _CANON
from tidegauge.streaming import states


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as memories: a key of three parts, a spectrum of the next four, and a score."""
    v = F.col("v")
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), *[v[i].alias(f"k{i + 1}") for i in range(3)], F.slice(v, 4, 4).alias("spec"), v[10].alias("improvement"), F.lit(1).cast("long").alias("n_obs"))


_MEMORY = "mem AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS k1, embedding[2]::DOUBLE AS k2, embedding[3]::DOUBLE AS k3, embedding[4]::DOUBLE AS s1, embedding[5]::DOUBLE AS s2, embedding[6]::DOUBLE AS s3, embedding[7]::DOUBLE AS s4, embedding[11]::DOUBLE AS improvement FROM embeddings)"
_FAR = "sqrt((m.k1 - q.k1) ** 2 + (m.k2 - q.k2) ** 2 + (m.k3 - q.k3) ** 2)"
_APART = "sqrt((m.s1 - q.s1) ** 2 + (m.s2 - q.s2) ** 2 + (m.s3 - q.s3) ** 2 + (m.s4 - q.s4) ** 2)"


@query(f"""WITH {_MEMORY}, near AS (SELECT q.id AS q, m.id, q.improvement AS eq, m.improvement AS em, row_number() OVER (PARTITION BY q.id ORDER BY {_FAR}, m.id) AS r FROM mem m, mem q WHERE q.id % 100 = 0 QUALIFY r <= 15)
    SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY r)::INT AS rank FROM near WHERE abs(em - eq) <= 0.1::DOUBLE QUALIFY rank <= 5""")
def f03_retrieve_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of fifteen nearest memories within a window of scores, for a fixed set of queries."""
    m = _memory(spark, sf_dir)
    q = m.where("id % 100 = 0")
    near = joins.nearest_keys(q.withColumnRenamed("id", "q"), m, 5, over=3).join(q.select(F.col("id").alias("q"), F.col("improvement").alias("eq")), "q")
    return regimes.retrieve_window(near, 5, "improvement", "eq", 0.1).select("q", "id", "rank")


@query(f"WITH {_MEMORY}, near AS (SELECT q.id AS q, m.id, {_APART} AS apart, row_number() OVER (PARTITION BY q.id ORDER BY {_FAR}, m.id)::INT AS rank FROM mem m, mem q WHERE q.id % 100 = 0 QUALIFY rank <= 20) SELECT q, id, rank FROM near WHERE apart < 0.25::DOUBLE")
def c17_retrieved_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of twenty nearest memories those whose spectra are near as well, for a fixed set of queries."""
    m = _memory(spark, sf_dir)
    q = m.where("id % 100 = 0")
    near = joins.nearest_keys(q.withColumnRenamed("id", "q"), m, 20).join(q.select(F.col("id").alias("q"), F.col("spec").alias("spec_q")), "q")
    return regimes.retrieved_confirmed(near, "spec", "spec_q", 0.25).select("q", "id", "rank")


@query(f"""WITH {_MEMORY}, hit AS (SELECT q.id AS new_id, m.id, q.improvement AS gain, {_FAR} AS far FROM mem m JOIN mem q ON m.id % 2 = 0 AND q.id % 2 = 1 AND {_FAR} <= 0.15::DOUBLE AND {_APART} < 0.25::DOUBLE),
    best AS (SELECT new_id, id, gain FROM hit QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY far, id) = 1), more AS (SELECT id, count(*) AS n, max(gain) AS top FROM best GROUP BY 1)
    SELECT mem.id, 1 + coalesce(n, 0) AS n_obs, round(greatest(improvement, coalesce(top, improvement)), 6) AS improvement FROM mem LEFT JOIN more USING (id) WHERE mem.id % 2 = 0
    UNION ALL SELECT id, 1, round(improvement, 6) FROM mem WHERE id % 2 = 1 AND id NOT IN (SELECT new_id FROM best)""")
def c16_merge_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of odd ids merged into those of even ids."""
    m = _memory(spark, sf_dir)
    return joins.merge_experience(m.where("id % 2 = 0"), m.where("id % 2 = 1")).select("id", "n_obs", *r6("improvement"))


@query()
def c13_shared_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of even and odd ids, matched one to one within each label."""
    v = F.col("v")
    c = vectors(spark, sf_dir).select("label", F.col("vec_id").alias("id"), F.abs(v[0]).alias("frequency"), v[1].alias("decay"), F.slice(v, 3, 8).alias("vector"))
    return joins.shared_characters(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "label", 0.01, 50)


@query("""WITH p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE + avg(embedding[4]::DOUBLE) OVER (PARTITION BY label) AS x, embedding[2]::DOUBLE + avg(embedding[5]::DOUBLE) OVER (PARTITION BY label) AS y, embedding[3]::DOUBLE AS value FROM embeddings)
    SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.1::DOUBLE AND (b.value > a.value OR b.value = a.value AND b.id < a.id))""")
def d31_merge_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each label moved by its centre; of near ones the best stays."""
    v = F.col("v")
    p = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("instance"), v[0].alias("x"), v[1].alias("y"), v[2].alias("value"), v[3].alias("cx"), v[4].alias("cy"))
    centers = p.groupBy("instance").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
    return relations.merge_discoveries(p.select("id", "instance", "x", "y", "value"), centers).select("id", *r6("x", "y"))


@query()
def d37_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document's chance of good quality by a model of its article features, if that is good enough."""
    from pyspark.ml.functions import vector_to_array

    feats = tx.article_features(F.col("text"))
    names = [k for k, c in feats.items()]
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", *[c.cast("double").alias(k) for k, c in feats.items()], F.log1p(F.col("n_chars").cast("double")).alias("energy"), "quality")
    model, auc = learning.retrain([rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")], names, "energy", "quality", least_auc=0.5, folds=3)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("chance"), F.lit(auc).alias("auc"))
    scored = model.transform(rows.withColumn("x", _vector([*names, "energy"])))
    return scored.select("doc_id", vector_to_array("probability")[1].alias("chance"), F.lit(auc).alias("auc"))


def _vector(names: list[str]) -> F.Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*[F.col(n) for n in names]).cast("array<double>"))


@query()
def d44_project_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much nearer each document's hashed vector is to the subspace of good documents than to that of others."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", embedding.hash_embed(F.col("text"), 32).alias("v")), "embedded")  # read once for each basis
    bases = learning.fit_subspaces(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "v", "quality", 4)
    if not {0, 1} <= set(bases):
        return docs.select("doc_id", F.lit(None).cast("double").alias("validity"))
    return learning.project_validity(docs, "v", bases[1], bases[0]).select("doc_id", "validity")


@query()
def d45_fiber_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels' eigenvalue ratios, pair by pair."""
    return learning.fiber_resonance(st.spectral_summary(st.source_profile(vectors(spark, sf_dir), "label", "v"), "label", 8), "label")


@query()
def d45_shared_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions that the subspaces of all labels have in common."""
    return learning.shared_directions(vectors(spark, sf_dir), "label", "v", 16)


@query("""WITH r AS (SELECT DISTINCT source AS repo, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM documents), g AS (SELECT DISTINCT item_id AS gap, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
    n AS (SELECT gap, count(*) AS n FROM g GROUP BY 1), s AS (SELECT gap, repo, count(*) / max(n) AS relevance FROM g JOIN r USING (w) JOIN n USING (gap) GROUP BY ALL) SELECT gap, repo, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY gap ORDER BY relevance DESC, repo)::INT AS rank FROM s QUALIFY rank <= 3""")
def f07_rank_for_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose documents share most words with each benchmark item."""
    repos = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.array_distinct(tx.tokens(F.col("text"))).alias("words"))
    gaps = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gap"), F.array_distinct(tx.tokens(F.col("text"))).alias("words"))
    return relations.rank_for_gap(repos, gaps, 3).select("gap", "repo", *r6("relevance"), "rank")


@query("""WITH l AS (SELECT p_name AS canonical, count(DISTINCT p_brand) AS n, bool_or(p_type = 'STANDARD') AS f FROM part GROUP BY 1), s AS (SELECT *, CASE WHEN f THEN 5 ELSE 1 END AS w FROM l)
    SELECT canonical, (sum(w) OVER (ORDER BY CASE WHEN f THEN 0 ELSE 1 END, -n, canonical) - w)::BIGINT AS first_dim FROM s""")
def f09_assign_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of part names in order of priority."""
    lib = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical")).agg(F.collect_set("p_brand").alias("domains"), F.bool_or(F.col("p_type") == "STANDARD").alias("f"))
    return relations.assign_dims(lib, "canonical", F.col("f"), F.when(F.col("f"), 5).otherwise(1)).select("canonical", F.col("first_dim").cast("long").alias("first_dim"))


@query()
def h18_parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as transcripts."""
    p = tx.parse_transcript(F.col("text"))
    sizes = [F.size(p[k]).alias(k) for k in ("guidance", "revenue_mentions", "eps_mentions")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(p["prepared_remarks"]).alias("prepared"), F.length(p["qa_section"]).alias("qa"), *sizes)


@query()
def h19_parse_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' texts as filings."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", tx.html_text(F.col("html")).alias("body"))
    p = tx.parse_filing(F.col("body"), F.col("url"))
    return pages.select("page_id", *[c.alias(k) for k, c in p.items()])


@query("SELECT doc_id, CASE WHEN contains(text, '\\exp') OR contains(text, 'e^') THEN 'exponential' WHEN contains(text, '\\sin') OR contains(text, '\\cos') OR contains(text, '\\tan') THEN 'trigonometric' WHEN contains(text, '\\log') OR contains(text, '\\ln') THEN 'logarithmic' WHEN contains(text, '^') THEN 'power' ELSE 'algebraic' END AS type, contains(text, '\\partial') OR regexp_matches(text, '\\\\nabla') OR regexp_matches(text, '\\\\frac\\{d|\\\\dot|\\\\ddot|d/dt') AS has_derivative, length(trim(text)) < 4 OR contains(text, '\\label') OR contains(text, '\\begin{') OR contains(text, '\\end{') OR contains(text, '\\hline') OR contains(text, '\\includegraphics') OR contains(text, '\\caption') OR contains(text, '\\centering') AS noise FROM documents")
def h22_equation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents told as equations: type, derivatives, noise (H-21, H-22, B-06)."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.equation_type(t).alias("type"), tx.annotate_equation(t)["has_derivative"].alias("has_derivative"), tx.is_equation_noise(t).alias("noise"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\\\[a-zA-Z]+|[a-zA-Z0-9]'))::INT AS size, round(len(regexp_extract_all(text, '[+\\-*/^=]|\\\\frac|\\\\cdot')) / greatest(len(regexp_extract_all(text, '\\\\[a-zA-Z]+|[a-zA-Z0-9]')), 1), 6) AS operator_ratio FROM documents")
def h34_expr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.expr_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", f["size"].cast("int").alias("size"), F.round(f["operator_ratio"], 6).alias("operator_ratio"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?:pip|npm|conda) install\\s+[A-Za-z0-9_.\\-@/]+'))::INT AS installs, len(regexp_extract_all(html, '\\[[^\\]]+\\]\\([^)\\s]+\\)'))::INT AS links, CASE WHEN regexp_matches(lower(url), 'basic|beginner|intro') THEN 0 WHEN contains(lower(url), 'intermediate') THEN 1 WHEN contains(lower(url), 'advanced') THEN 2 WHEN contains(lower(url), 'expert') THEN 3 ELSE 1 END AS difficulty FROM pages")
def h39_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Install commands, Markdown links and difficulty of pages (H-37, H-39, F-08)."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(tx.installs(F.col("html"))).alias("installs"), F.size(tx.markdown_links(F.col("html"))).alias("links"), tx.difficulty(F.col("url")).alias("difficulty"))


def _spectrum(v: F.Column, n: int) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get(v, i * 2).alias("re"), F.get(v, i * 2 + 1).alias("im")))


@query("""WITH z AS (SELECT vec_id, list_transform(range(0, 32), lambda i: sqrt(embedding[i * 2 + 1]::DOUBLE ** 2 + embedding[i * 2 + 2]::DOUBLE ** 2)) AS m, list_transform(range(0, 32), lambda i: abs(embedding[i * 2 + 2]::DOUBLE)) AS im,
        list_reverse_sort(list_transform(range(0, 32), lambda i: {'m': sqrt(embedding[i * 2 + 1]::DOUBLE ** 2 + embedding[i * 2 + 2]::DOUBLE ** 2), 're': embedding[i * 2 + 1]::DOUBLE, 'im': embedding[i * 2 + 2]::DOUBLE})) AS z FROM embeddings)
    SELECT vec_id, round(list_max(m), 6) AS radius, len(list_filter(m, lambda x: x > 0.9::DOUBLE))::INT AS n_slow, len(list_filter(im, lambda x: x > 0.1::DOUBLE))::INT AS n_oscillating,
        round(z[1].re, 6) AS re_1, round(z[1].im, 6) AS im_1, round(z[2].re, 6) AS re_2, round(z[2].im, 6) AS im_2, round(z[3].re, 6) AS re_3, round(z[3].im, 6) AS im_3, round(z[4].re, 6) AS re_4, round(z[4].im, 6) AS im_4 FROM z""")
def h42_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spectral.invariants(F.col("z"), 4)
    return vectors(spark, sf_dir).withColumn("z", _spectrum(F.col("v"), 32)).select(
        "vec_id", F.round(f["radius"], 6).alias("radius"), f["n_slow"].alias("n_slow"), f["n_oscillating"].alias("n_oscillating"), *[F.round(f[f"top_{part}"][i], 6).alias(f"{part}_{i + 1}") for i in range(4) for part in ("re", "im")]
    )


@query("""WITH x AS (SELECT vec_id, label, list_slice(embedding, 1, 63)::DOUBLE[] AS s, embedding[64]::DOUBLE AS c, 1 + vec_id % 5 AS r FROM embeddings), f AS (SELECT label, s AS s0, c AS c0, r AS r0 FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
    n AS (SELECT *, sqrt(list_sum(list_transform(s, lambda a: a * a))) AS k, sqrt(list_sum(list_transform(s0, lambda a: a * a))) AS k0 FROM x JOIN f USING (label))
    SELECT vec_id, round(0.5::DOUBLE * sqrt(list_sum(list_transform(range(1, 64), lambda i: (s[i] / k - s0[i] / k0) ** 2))) + 0.3::DOUBLE * abs(c - c0) + 0.2::DOUBLE * abs(r - r0) / greatest(r, r0, 1), 6) AS distance FROM n""")
def h46_patch_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each patch to the first one of its label."""
    x = vectors(spark, sf_dir).select("vec_id", "label", F.slice("v", 1, 63).alias("s"), F.col("v")[63].alias("c"), (1 + F.col("vec_id") % 5).alias("r"))
    first = x.groupBy("label").agg(F.min_by(F.struct(F.col("s").alias("s0"), F.col("c").alias("c0"), F.col("r").alias("r0")), "vec_id").alias("f")).select("label", "f.*")
    return x.join(first, "label").select("vec_id", F.round(embedding.patch_distance(*[F.col(c) for c in ("s", "s0", "c", "c0", "r", "r0")]), 6).alias("distance"))


@query()
def h54_intent_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as intents, with their densities as the profile."""
    items = table(spark, sf_dir, "benchmark").select("item_id", embedding.hash_embed(F.col("text"), 64).alias("e"), F.array(*[c.cast("double") for c in tx.densities(F.col("text")).values()]).alias("p"))
    return items.select("item_id", embedding.intent_vector(F.col("e"), F.col("p")).alias("v"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, NOT list_bool_or(flatten(list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: j > i AND abs(v[i] - v[j]) < 0.001::DOUBLE)))) AS safe,
    round(list_max(list_transform(range(0, 21), lambda i: v[i * 2 + 1] * (1 + v[i + 44]))), 6) AS margin FROM x""")
def h57_scaled_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapse check of all frequencies, and the stability margin of a spectrum of 21 values scaled by the last 21 parts
    (H-57, B-07)."""
    z = spectral.scale_spectrum(_spectrum(F.col("v"), 21), F.transform(F.slice("v", 44, 21), lambda x: 1 + x))
    return vectors(spark, sf_dir).select("vec_id", spectral.collapse_safe(F.col("v"), 0.001).alias("safe"), F.round(spectral.hurwitz_margin(z), 6).alias("margin"))


@query("SELECT p_partkey, round(least(3, greatest(-3, ln(greatest(p_retailprice / 1000, 1e-12::DOUBLE)))), 6) AS throughput, round(least(3, greatest(-3, ln(greatest(p_size / 10.0::DOUBLE, 1e-12::DOUBLE)))), 6) AS intensity, round(least(3, greatest(-3, p_size / 15.0::DOUBLE)), 6) AS ratio FROM part")
def h58_perf_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regimes.perf_invariants(F.col("p_retailprice") / 1000, F.col("p_size") / 10.0, F.col("p_size") / 15.0)
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("throughput", "intensity", "ratio"))])


@query("""WITH z AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), f AS (SELECT vec_id, list_concat([v[60], v[61], v[62]], [(label = 0)::INT::DOUBLE, (label = 1)::INT::DOUBLE, (label = 2)::INT::DOUBLE, (label = 3)::INT::DOUBLE], [v[1], v[3], v[5], v[7]], [v[2], v[4], v[6], v[8]]) AS f FROM z)
    SELECT vec_id, len(f)::INT AS n, round(list_sum(list_transform(range(1, 16), lambda i: f[i] * i)), 6) AS weighted FROM f""")
def h59_region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen features of each vector as a region, told by their size and a weighted sum."""
    rows = vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("kind"), *[F.col("v")[59 + i].alias(f"x{i}") for i in range(3)], _spectrum(F.col("v"), 32).alias("z"))
    f = regimes.region_features(rows, ["x0", "x1", "x2"], "kind", ["0", "1", "2", "3"], "z")
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return f.select("vec_id", F.size("features").alias("n"), F.round(weighted, 6).alias("weighted"))


@query("""WITH e AS (SELECT user_id, event_id, abs(value / 500 - coalesce(lag(value / 500) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS err, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(max(0.5::DOUBLE * 0.95::DOUBLE ** n) + sum(0.05::DOUBLE / (1 + err) * 0.95::DOUBLE ** (n - i)), 6) AS trust FROM e GROUP BY 1""")
def j04_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's trust after its last event; the value before stands in for the forecast."""
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("x"))
    told = states.reliability(e.withColumn("before", F.coalesce(F.lag("x").over(by_user), F.lit(0.0))), "user_id", "event_id", "before", "x")
    return told.groupBy("user_id").agg(F.round(F.max_by("trust", "event_id"), 6).alias("trust"))


@query()
def j06_duffing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as amplitudes and their steps as frequencies of the backbone."""
    from tidegauge.streaming.folds import BackboneFilter, fold

    by_user = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("amplitude"), F.lit(True).alias("active"))
    return fold(e.withColumn("frequency", F.abs(F.col("amplitude") - F.lag("amplitude").over(by_user))), "user_id", "event_id", BackboneFilter("frequency", "amplitude", "active")).drop("active")


@query("SELECT user_id, event_id, round(0.3::DOUBLE * value / 500, 6) AS delta_regime, round(0.2::DOUBLE * (value / 1000 + 0.3::DOUBLE * value / 500), 6) AS delta_fundamental FROM events")
def j15_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as shocks, passed up two scales."""
    e = states.propagate(table(spark, sf_dir, "events"), F.col("value") / 500, F.col("value") / 1000, 0.3, 0.2)
    return e.select("user_id", "event_id", *r6("delta_regime", "delta_fundamental"))


@query("""WITH z AS (SELECT vec_id, label, list_max(list_transform(range(0, 32), lambda i: {'re': embedding[i * 2 + 1]::DOUBLE, 'im': abs(embedding[i * 2 + 2]::DOUBLE)})) AS t, list_max(list_transform(range(0, 32), lambda i: abs(embedding[i * 2 + 2]::DOUBLE))) AS most FROM embeddings),
    b AS (SELECT *, lag(t.re) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM z), s AS (SELECT *, CASE WHEN before < 0 AND t.re >= 0 THEN 'bifurcation' WHEN abs(t.re) <= 0.05::DOUBLE THEN 'critical' ELSE 'stable' END AS status FROM b)
    SELECT vec_id, label, status, CASE WHEN status = 'stable' THEN NULL WHEN t.im > 0.000001::DOUBLE THEN 'hopf' ELSE 'saddle_node' END AS type, round(t.re, 6) AS top, round(abs(t.re), 6) AS distance, round(coalesce(t.re - before, 0), 6) AS step, round(most, 6) AS turn FROM s""")
def e09_bifurcation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of each label's vectors in order of their ids."""
    z = vectors(spark, sf_dir).select("vec_id", "label", _spectrum(F.col("v"), 32).alias("z"))
    told = regimes.bifurcation_status(z, ["label"], "vec_id", "z")
    return told.select("vec_id", "label", "status", "type", *[F.round(F.col("features")[i], 6).alias(k) for i, k in enumerate(("top", "distance", "step", "turn"))])


@query("""WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, v AS w FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT vec_id, round(1 / (1 + list_min(flatten(list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j: abs(v[i] - w[j])))))), 6) AS resonance FROM x JOIN f USING (label)""")
def d14_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resonance of each spectrum with the first one of its label."""
    x = vectors(spark, sf_dir)
    first = x.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"))
    return x.join(first, "label").select("vec_id", F.round(spectral.resonance(F.col("v"), F.col("w")), 6).alias("resonance"))


@query("""WITH s AS (SELECT source, text, lang FROM documents), g AS (SELECT lower(trim(text)) AS c, count(DISTINCT lang) AS n FROM s GROUP BY 1) SELECT n AS n_domains, count(*) AS functions FROM g WHERE n >= 1 GROUP BY 1""")
def d28_universal_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts are in how many languages."""
    lib = table(spark, sf_dir, "documents").groupBy(F.lower(F.trim("text")).alias("c")).agg(F.collect_set("lang").alias("domains"))
    return relations.universal_functions(lib, 1).groupBy(F.size("domains").cast("long").alias("n_domains")).agg(F.count("*").alias("functions"))


@query("SELECT vec_id, round(0.4::DOUBLE * (1 - abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE)) + 0.2::DOUBLE * (label < 3)::INT + 0.4::DOUBLE * list_cosine_similarity(list_slice(embedding, 1, 32)::DOUBLE[], list_slice(embedding, 33, 64)::DOUBLE[]), 6) AS score FROM embeddings")
def d41_resonance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    score = regimes.resonance_score(v[0], v[1], F.col("label") < 3, F.slice(v, 1, 32), F.slice(v, 33, 32))
    return vectors(spark, sf_dir).select("vec_id", F.round(score, 6).alias("score"))


@query("WITH e AS (SELECT user_id, kurtosis_pop(value / 500) AS k, corr(value, event_id) AS a, stddev_pop(value / 500) AS s, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN n < 5 THEN 1 ELSE greatest(0.1::DOUBLE, 1 - a) END, 6) AS alpha, round(CASE WHEN n < 5 THEN 0.1::DOUBLE ELSE greatest(0, k / 10) END, 6) AS beta, round(CASE WHEN n < 5 THEN 0.3::DOUBLE ELSE greatest(0.01::DOUBLE, s) END, 6) AS delta FROM e")
def d13_duffing_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.kurtosis(F.col("value") / 500).alias("k"), F.corr("value", F.col("event_id").cast("double")).alias("a"), F.stddev_pop(F.col("value") / 500).alias("s"), F.count("*").alias("n"))
    p = regimes.duffing_params(F.col("k"), F.col("a"), F.col("s"), F.col("n"))
    return e.select("user_id", *[F.round(c, 6).alias(k) for k, c in p.items()])


@query("""WITH p AS (SELECT vec_id, [label] AS d, embedding[1]::DOUBLE AS s, vec_id // 2 % 5 AS t FROM embeddings) SELECT vec_id FROM p f WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p k WHERE k.vec_id % 2 = 0 AND k.d = f.d AND abs(k.s - f.s) <= 0.001::DOUBLE AND k.t = f.t)""")
def c04_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of odd ids as found pairs, those of even ids as known ones."""
    p = vectors(spark, sf_dir).select("vec_id", F.array("label").alias("dimensions"), F.col("v")[0].alias("similarity"), F.array(F.floor(F.col("vec_id") / 2) % 5).alias("types"))
    return joins.new_only(p.where("vec_id % 2 = 1"), p.where("vec_id % 2 = 0"), 0.001).select("vec_id")


@query("SELECT p_partkey, round(tanh(p_retailprice / 1000 - 1), 6) AS long, round(tanh(p_size / 50.0::DOUBLE + (50 - p_size) / 100.0::DOUBLE), 6) AS medium, round(0.5::DOUBLE * p_size / 50 * 0.8::DOUBLE, 6) AS short FROM part")
def h28_horizon_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    h = regimes.horizon_predictions(F.col("p_retailprice") / 1000 - 1, size / 50, size, F.lit(0.5), size / 50, F.lit(0.8))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 6).alias(k) for k, c in h.items()])


@query("WITH t AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE value <> 0) SELECT user_id, event_id, round(coalesce((value - b) / b, 0), 6) AS momentum FROM t")
def j01_tick_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the tick stream over all events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return states.tick_state(e, "user_id", "event_id", "value").select("user_id", "event_id", *r6("momentum"))


@query(f"WITH {_CANON} SELECT substr(md5(canonical), 1, 12) AS url_key, min(page_id) AS page_id FROM canon3 GROUP BY 1")
def j11_dedup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of each URL; the id stands in for the time."""
    return states.dedup_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id").select("url_key", "page_id")


@query()
def d08_calendar_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's orders from the day before, and what is left of them by each calendar channel's phase."""
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 1e6).alias("total"), (F.count("*") / 10.0).alias("n"))
    pairs = daily.select("d", F.array("total", "n").alias("y")).join(daily.select(F.date_add("d", 1).alias("d"), F.array("total", "n").alias("x")), "d")
    channels = cal_ops.phases(pairs.select("d")).select("d", F.posexplode(F.arrays_zip("theta", "amplitudes")).alias("channel", "p")).select("d", "channel", F.col("p.theta").alias("theta"), F.col("p.amplitudes").alias("amplitude"))
    return st.fit_calendar_stages(pairs, channels.withColumn("channel", F.col("channel").cast("string")), "d", "x", "y")


@query("""SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM pages UNION ALL SELECT page_id, 'token', unnest(list_filter(string_split_regex(lower(trim(url)), '\\s+'), lambda t: t <> '')) FROM pages""")
def k06_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages and tokens of their URLs by SQL table functions."""
    tables.register(spark)
    return spark.sql("SELECT p.page_id, 'link' AS kind, l.href AS value FROM {pages} p, LATERAL page_links(p.html) l UNION ALL SELECT p.page_id, 'token', t.token FROM {pages} p, LATERAL text_tokens(p.url) t", pages=table(spark, sf_dir, "pages"))


@query(f"WITH {_DAYS}, {_EVENTS} SELECT d, c::INT AS channel, round(amp * exp(2 * (cos(theta) - 1)), 6) AS weight FROM phased")
def h26_von_mises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the calendar channels on every order date."""
    p = cal_ops.phases(days(spark, sf_dir)).select("d", F.posexplode(F.arrays_zip("theta", "amplitudes")).alias("channel", "p"))
    return p.select("d", "channel", F.round(spectral.von_mises(F.col("p.amplitudes"), F.col("p.theta"), 2.0), 6).alias("weight"))


@query()
def i04_merge_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly parallel vectors as one."""
    return graph.merge_redundant(vectors(spark, sf_dir), "vec_id", "v", 0.05)


@query("""WITH u AS (SELECT user_id, event_id // 100 AS g, CASE WHEN event_type IN ('click', 'view') THEN 'bid' ELSE 'offer' END AS side, value FROM events), t AS (SELECT user_id, g, coalesce(sum(value) FILTER (side = 'bid'), 0) AS bid, coalesce(sum(value) FILTER (side = 'offer'), 0) AS ask FROM u GROUP BY ALL)
    SELECT user_id::VARCHAR AS product_id, count(*) AS n, round(avg((bid - ask) / (bid + ask)), 6) AS imbalance FROM t WHERE bid + ask > 0 GROUP BY 1""")
def j02_book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as book messages in JSON, parsed and weighed."""
    side = F.when(F.col("event_type").isin("click", "view"), "bid").otherwise("offer")
    books = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100)).agg(F.collect_list(F.struct(side.alias("side"), F.col("value").cast("string").alias("qty"))).alias("updates"))
    lines = books.select(F.to_json(F.struct(F.lit("l2_data").alias("channel"), F.array(F.struct(F.col("user_id").cast("string").alias("product_id"), "updates")).alias("events"))).alias("value"))
    told = states.book_imbalance(states.parse_l2(lines))
    return told.groupBy("product_id").agg(F.count("*").alias("n"), F.round(F.avg("imbalance"), 6).alias("imbalance"))
