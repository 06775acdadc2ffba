"""Queries on documents and pages as sources: concept graphs, profiles of sources, batches, page summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import lexicons as lex
from tidegauge.functions import text as tx
from tidegauge.operators import concepts, joins, learning, profiles, regimes
from tidegauge.operators import windows as win
from tidegauge.plans.more import _MODES, _modes, vectors
from tidegauge.plans.registry import query, table
from tidegauge.plans.statistics import _RAT
from tidegauge.plans.text import _DIMS, _LEX, _list, _places

# Concepts without lookahead: every mark is doubled, so that one of the two may be taken on either side of a word.
_NAMES = r"""seen AS (SELECT doc_id, s, regexp_replace(s, '([^\p{L}\p{M}\p{N}_])', '\1\1', 'g') AS d FROM (SELECT doc_id, unnest(string_split_regex(text, '\n#{1,4}\s|\n-{3,}\n|\n{3,}')) AS s FROM documents)),
    raw AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(s, '\*\*([^*]{3,40})\*\*', 1), regexp_extract_all(s, '`([^`]{2,30})`', 1))) AS c FROM seen
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(d, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Z][a-z]{2,}(?:(?:  |_)[A-Z][a-z]+)*)(?:[^\p{L}\p{M}\p{N}_]|$)', 1)) FROM seen
        UNION ALL SELECT doc_id, unnest(list_concat(""" + ", ".join(rf"regexp_extract_all(d, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([\p{{L}}\p{{M}}\p{{N}}_]{{3,20}})\s+{w}(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)', 1)" for w in ("is", "refers", "means", "denotes")) + r""")) FROM seen),
    names AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, regexp_replace(lower(trim(c, E' \t\n\r')), '\s+', '_', 'g') AS name FROM raw) WHERE length(name) BETWEEN 3 AND 39)"""


@query(rf"""WITH {_NAMES}, t AS (SELECT doc_id, lower(text) AS low, greatest(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 1) AS n FROM documents),
    para AS (SELECT doc_id, row_number() OVER () AS line, s FROM (SELECT doc_id, unnest(string_split(lower(text), E'\n')) AS s FROM documents) WHERE regexp_matches(s, '\S')), m AS (SELECT doc_id, count(*) AS m FROM para GROUP BY 1),
    term AS (SELECT doc_id, name, translate(name, '_', ' ') AS term FROM names), p AS (SELECT doc_id, name, term, (length(low) - length(replace(low, term, ''))) / length(term) / n AS p FROM term JOIN t USING (doc_id)),
    held AS (SELECT para.doc_id, line, name, p FROM p JOIN para ON p.doc_id = para.doc_id AND contains(s, term) WHERE p > 0),
    j AS (SELECT x.doc_id, x.name AS a, y.name AS b, x.p AS p, y.p AS q, count(*) AS k FROM held x JOIN held y ON x.doc_id = y.doc_id AND x.line = y.line AND x.name <> y.name GROUP BY ALL)
    SELECT doc_id, a, b, round(k / m * log2(k / m / (p * q + 1e-12::DOUBLE)), 6) AS weight FROM j JOIN m USING (doc_id) WHERE k / m * log2(k / m / (p * q + 1e-12::DOUBLE)) > 0.005::DOUBLE""")
def d30_concept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all concepts of each document, its lines being the paragraphs."""
    g = concepts.concept_graph(table(spark, sf_dir, "documents"), "doc_id", "text", paragraph="\n")
    return g.select("doc_id", "a", "b", F.round("weight", 6).alias("weight"))


#: Own profiles, an example for K-04: one takes a listed domain's place, the others come after the listed ones.
OWN = [(0, "ft.com", "Fetcher", 0.5, "paid", True, False), (1, "blog.", "Fetcher", 0.2, "blog", True, False), (2, "example.org", "Fetcher", 1.0, "wiki", True, False), (3, "example", "Fetcher", 1.0, "site", False, False)]
_TRIED = [*[next((o[1:] for o in OWN if o[1] == p[0]), p) for p in lex.PROFILES], *[o[1:] for o in OWN if o[1] not in {p[0] for p in lex.PROFILES}]]
_PROFILES = ", ".join(f"({i}, '{p[0]}', {p[2]}::DOUBLE, '{p[3]}')" for i, p in enumerate(_TRIED))


@query(f"""WITH p(ord, domain, wait, parser) AS (VALUES {_PROFILES}), h AS (SELECT page_id, lower(regexp_extract(url, '^[^:/]+://([^/:?#]*)', 1)) AS host FROM pages),
    m AS (SELECT page_id, min(ord) AS ord FROM h JOIN p ON contains(host, domain) GROUP BY 1) SELECT h.page_id, p.domain, p.parser, p.wait FROM h LEFT JOIN m USING (page_id) LEFT JOIN p USING (ord)""")
def k04_own_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first source profile that fits their host, with own profiles among them."""
    own = spark.createDataFrame(OWN, profiles.PROFILE)
    found = profiles.match_source(table(spark, sf_dir, "pages"), profiles.with_profiles(profiles.default_profiles(spark), own))
    return found.select("page_id", "profile.domain", "profile.parser", "profile.wait")


_TOK = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_SENT = f"lex(w, v) AS (VALUES {_LEX}), hit AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), sent AS (SELECT doc_id, least(1, greatest(-1, sum(v) / sqrt(count(*)))) AS s FROM hit JOIN lex USING (w) GROUP BY 1)"


@query(f"""WITH {_SENT}, d AS (SELECT source, coalesce(s, 0) AS s, len(list_distinct({_TOK})) / greatest(len({_TOK}), 1) AS n FROM documents LEFT JOIN sent USING (doc_id))
    SELECT source, count(*) AS n, round(avg(s), 6) AS sentiment_mean, round(stddev_pop(s), 6) AS sentiment_std, round(avg(n), 6) AS novelty_mean, round(stddev_pop(n), 6) AS novelty_std FROM d GROUP BY 1""")
def d04_source_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment, and the share of words that are new to their document, by source."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("source", tx.lexicon_sentiment(F.col("text")).alias("sentiment"), (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("novelty"))
    m = profiles.source_moments(d, "source", ["sentiment", "novelty"])
    return m.select("source", "n", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


@query(f"""WITH {_SENT}, t AS (SELECT source, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '[^A-Za-z0-9_]+'), lambda x: regexp_extract(x, '^([A-Z]{{2,5}})$', 1)), lambda x: x <> '' AND NOT list_contains({_list(lex.NO_TICKERS)}, x))) AS t FROM documents),
    c AS (SELECT source, count(DISTINCT t) AS k FROM t GROUP BY 1), m AS (SELECT source, count(*) AS n, avg(coalesce(s, 0)) AS s FROM documents LEFT JOIN sent USING (doc_id) GROUP BY 1) SELECT source, n, coalesce(k, 0) AS n_tickers, round(s, 6) AS mean_sentiment FROM m LEFT JOIN c USING (source)""")
def d03_article_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "documents").select("source", tx.tickers(F.regexp_replace("text", "[^\\x00-\\x7F]", "_")).alias("t"), tx.lexicon_sentiment(F.col("text")).alias("s"))
    short, _ = profiles.article_batch(read, "source", "t", "s")
    return short.select("source", "n", "n_tickers", F.round("mean_sentiment", 6).alias("mean_sentiment"))


@query()
def d06_source_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of each vector from the others, by label; a vector's hours are its number within the week."""
    v = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    rows = v.select("label", F.slice("v", F.lit(1), F.size("v") - 1).alias("x"), F.element_at("v", -1).alias("y"), (F.col("vec_id") % 168).alias("hours"))
    return profiles.fit_transfer(rows, "label", "x", "y", "hours")


@query("""WITH p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45), r AS (SELECT p_brand || '_' || p_partkey AS id FROM part LEFT JOIN p ON l_partkey = p_partkey WHERE l_partkey IS NULL), f AS (SELECT id FROM r ORDER BY id LIMIT 10)
    SELECT string_split(r.id, '_')[1] AS prefix, count(*) AS uncovered, count(f.id) AS among_first FROM r LEFT JOIN f ON r.id = f.id GROUP BY 1""")
def d23_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_brand", "p_partkey").alias("id"), "p_partkey")
    hit = ids.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    counts, first = profiles.uncovered(hit, ids, "id")
    among = first.groupBy(F.split("id", "_")[0].alias("prefix")).agg(F.count("*").alias("among_first"))
    return counts.join(among, "prefix", "left").select("prefix", "uncovered", F.coalesce("among_first", F.lit(0)).alias("among_first"))


@query(r"""WITH f AS (SELECT lower(regexp_extract(url, '^[^:/]+://([^/:?#]*)', 1)) AS repo, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages), x AS (SELECT repo, path, regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]+)$', 1) AS ext FROM f),
    e AS (SELECT repo, ext, count(*) AS n FROM x WHERE ext <> '' GROUP BY ALL), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, ext) = 1), d AS (SELECT repo, list_sort(list(DISTINCT string_split(path, '/')[1]))[1:10] AS dirs FROM x WHERE contains(path, '/') AND string_split(path, '/')[1] <> '' GROUP BY 1)
    SELECT r.repo, coalesce(b.ext, 'unknown') AS language, coalesce(b.n, 0) AS n_files, coalesce(array_to_string(dirs, ','), '') AS directories FROM (SELECT DISTINCT repo FROM x) r LEFT JOIN b USING (repo) LEFT JOIN d USING (repo)""")
def d29_repo_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as repositories and the paths of their pages as files."""
    files = table(spark, sf_dir, "pages").select(tx.host(F.col("url")).alias("repo"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return profiles.repo_insights(files, "repo", "path").withColumn("directories", F.array_join("directories", ","))


@query("""WITH q AS (SELECT vec_id AS q, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + i % 3)) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS template, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q)
    SELECT q, template, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, template) = 1 AND c > 0.75::DOUBLE""")
def c15_match_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed set of vectors, each part weighed by its place, against all stored ones."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    new = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.transform("v", lambda x, i: x * (1 + (i + 1) % 3)).alias("v"))
    return profiles.match_template(new, v.withColumnRenamed("vec_id", "id")).select("q", "template", F.round("similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT vec_id AS id, list_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s FROM embeddings), d AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(range(1, 65), lambda k: abs(a.s[k] - b.s[k]))) / 64 AS d FROM e a JOIN e b ON a.id < b.id)
    SELECT a, b, round(d, 6) AS distance FROM d WHERE d < 0.006::DOUBLE""")
def c05_equivalent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with nearly the same sizes of parts, over all labels."""
    return profiles.equivalent_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.006, digits=6)


@query("""WITH l AS (SELECT user_id, floor(value / 100) AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events), s AS (SELECT user_id, count(*) AS n, max(level) FILTER (r = 1) AS a, max(level) FILTER (r = 10) AS b FROM l WHERE r <= 10 GROUP BY 1)
    SELECT user_id, round((a - b) / 9, 6) AS velocity FROM s WHERE n = 10 AND a = b""")
def e12_stagnant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last ten events begin and end in the same hundred."""
    x = table(spark, sf_dir, "events").select("user_id", "ts", F.floor(F.col("value") / 100).cast("double").alias("level"))
    return win.stagnant(x, ["user_id"], "ts", "level").select("user_id", F.round("velocity", 6).alias("velocity"))


_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: NOT starts_with(l, '#'))"


@query(rf"SELECT doc_id, array_to_string(list_filter(list_transform({_LINES}, lambda l: regexp_replace(regexp_extract(l, '^([^>=<!;\[]*)', 1), '^\s+|\s+$', '', 'g')), lambda l: l <> '')[1:20], '|') AS names FROM documents")
def h37_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as requirement lists."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.dependencies(F.col("text"), package_json=F.lit(False)), "|").alias("names"))


_KINDS = ["algebraic", "exponential", "logarithmic", "power", "trigonometric"]


@query(rf"""WITH {_DIMS}, k AS (SELECT doc_id, lang AS domain, CASE WHEN contains(text, '\exp') OR contains(text, 'e^') THEN 'exponential' WHEN contains(text, '\sin') OR contains(text, '\cos') OR contains(text, '\tan') THEN 'trigonometric' WHEN contains(text, '\log') OR contains(text, '\ln') THEN 'logarithmic' WHEN contains(text, '^') THEN 'power' ELSE 'algebraic' END AS type FROM documents),
    n AS (SELECT doc_id, count(DISTINCT dim) AS n FROM dims GROUP BY 1), j AS (SELECT domain, type, n FROM k JOIN n USING (doc_id)) SELECT domain, """ + ", ".join(f"coalesce(sum(n) FILTER (type = '{t}'), 0)::BIGINT AS {t}" for t in _KINDS) + " FROM j GROUP BY 1")
def d40_overlap_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active places of documents by language and by the kind of equation that their text looks like."""
    library = table(spark, sf_dir, "documents").select("doc_id", F.array("lang").alias("domains"), tx.equation_type(F.col("text")).alias("type"))
    return learning.overlap_heatmap(library, _places(spark, sf_dir, "doc_id"), "doc_id", _KINDS)


@query()
def h38_repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as repositories: paragraphs and headings of the page are its readme, its links are its files."""
    md = F.regexp_replace(F.regexp_replace("html", r"(?is)<h[1-6][^>]*>", "\n\n## "), r"(?is)</h[1-6]>|<p[^>]*>|</p>", "\n\n")
    readme = F.regexp_replace(F.regexp_replace(F.regexp_replace(md, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<[^>]*>", ""), r"\n{3,}", "\n\n")
    files = F.transform(tx.hrefs(F.col("html")), lambda h: F.ltrim(h, F.lit("/")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit(None).cast("string").alias("d"), readme.alias("readme"), files.alias("files"))
    return profiles.repo_summary(pages, "page_id", "d", "readme", "files")


def _plain_sql(c: str) -> str:
    for pattern in (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{mark}')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_INSIDE = {tag: _plain_sql(rf"regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}>|\z)', 1)") for tag in ("title", "h1", "body")}


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title(?:\s[^>]*)?>') THEN {_INSIDE['title']} ELSE {_INSIDE['h1']} END AS headline, md5({_INSIDE['body']}) AS body_md5, len(list_filter(string_split_regex({_INSIDE['body']}, '\s+'), lambda w: w <> '')) AS n_words FROM pages""")
def h17_generic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline, body and words of pages of which no source's own elements are known."""
    found = table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in tx.article_fields(F.col("html")).items()])
    return found.select("page_id", "headline", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.col("n_words").cast("long").alias("n_words"))


_LOCKS = f"""{_MODES}, fit AS (SELECT * FROM modes WHERE 1 / (1 + abs(alpha)) >= 0.6::DOUBLE AND abs(alpha) < 1),
    pairs AS (SELECT x.vec_id, x.idx AS ia, y.idx AS ib, x.omega AS fa, y.omega AS fb FROM fit x JOIN fit y ON x.vec_id = y.vec_id AND x.idx < 16 AND y.idx >= 16 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY x.idx, y.idx) <= 15),
    r(p, q) AS (VALUES {_RAT}), far AS (SELECT vec_id, ia, ib, fa / fb AS x, min(abs(fa - p / q::DOUBLE * fb)) AS tau FROM pairs, r GROUP BY ALL),
    cf AS (SELECT vec_id, ia, ib, x AS r, 1::DOUBLE AS p, 0::DOUBLE AS p0, 0::DOUBLE AS q, 1::DOUBLE AS q0, 0 AS step FROM far UNION ALL SELECT vec_id, ia, ib, CASE WHEN r - floor(r) > 1e-9::DOUBLE THEN 1 / (r - floor(r)) END, floor(r) * p + p0, p, floor(r) * q + q0, q, step + 1 FROM cf WHERE r IS NOT NULL AND step < 20 AND floor(r) * q + q0 <= 8),
    best AS (SELECT vec_id, ia, ib, p::BIGINT AS p, q::BIGINT AS q FROM cf QUALIFY row_number() OVER (PARTITION BY vec_id, ia, ib ORDER BY step DESC) = 1),
    locks AS (SELECT vec_id, ia, ib, tau, exp(-tau / 0.05::DOUBLE) AS lock, p, q, abs(x - p / q) AS off FROM far JOIN best USING (vec_id, ia, ib))"""


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _modes(spark, sf_dir).select("vec_id", "idx", F.col("omega").alias("frequency"), (1 / (1 + F.abs("alpha"))).alias("stability"), F.abs("alpha").alias("variance"))
    return joins.mode_locks(m.where("idx < 16"), m.where("idx >= 16"), "vec_id", 0.05)


@query(f"WITH RECURSIVE {_LOCKS} SELECT vec_id, ia, ib, round(tau, 6) AS tau, round(lock, 6) AS lock, p, q, round(off, 6) AS off FROM locks")
def c11_mode_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of the first half of each vector against those of its second half."""
    return _locks(spark, sf_dir).select("vec_id", "ia", "ib", F.round("tau", 6).alias("tau"), F.round("lock", 6).alias("lock"), "p", "q", F.round("off", 6).alias("off"))


@query(f"""WITH RECURSIVE {_LOCKS}, best_lock AS (SELECT * FROM locks QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY lock DESC, ia, ib) = 1), mean AS (SELECT vec_id, avg(lock) AS c FROM locks GROUP BY 1),
    share AS (SELECT vec_id, idx < 16 AS a, omega / sum(omega) OVER (PARTITION BY vec_id, idx < 16) AS s FROM modes), ent AS (SELECT vec_id, sum(-s * ln(s)) FILTER (a) - sum(-s * ln(s)) FILTER (NOT a) AS d FROM share GROUP BY 1)
    SELECT e.vec_id, round(coalesce(c, 0), 6) AS coherence, ia, ib, p, q, round(d, 6) AS entropy_drop FROM ent e LEFT JOIN mean USING (vec_id) LEFT JOIN best_lock USING (vec_id)""")
def c11_coherence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _modes(spark, sf_dir)
    totals = m.groupBy("vec_id").agg(*[F.struct(F.sum(F.when(c, F.col("omega"))).alias("t"), F.sum(F.when(c, F.col("omega") * F.log("omega"))).alias("l")).alias(n) for n, c in (("a", F.col("idx") < 16), ("b", F.col("idx") >= 16))])
    entropy = lambda n: F.log(F.col(f"{n}.t")) - F.col(f"{n}.l") / F.col(f"{n}.t")
    state = joins.coherence_state(_locks(spark, sf_dir), totals.select("vec_id", entropy("a").alias("first"), entropy("b").alias("second")), "vec_id")
    return state.select("vec_id", F.round("coherence", 6).alias("coherence"), "dominant.ia", "dominant.ib", "dominant.p", "dominant.q", F.round("entropy_drop", 6).alias("entropy_drop"))


#: Examples of shifts: how calendar amplitudes (5) and regime shares (4) move the logits of the three horizons.
CALENDAR_SHIFT = [[0.0, 0.2, 0.5], [0.3, 0.1, 0.0], [0.0, 0.4, 0.2], [0.1, 0.3, 0.0], [0.2, 0.0, -0.3]]
REGIME_SHIFT = [[0.4, 0.0, -0.2], [0.0, 0.5, 0.0], [-0.2, 0.0, 0.6], [0.1, 0.1, 0.1]]
_SHIFTS = [" + ".join(f"({r[h]}::DOUBLE) * {n}[{k + 1}]" for n, m in (("cal", CALENDAR_SHIFT), ("reg", REGIME_SHIFT)) for k, r in enumerate(m)) for h in range(3)]


@query(f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS u FROM embeddings), c AS (SELECT vec_id, list_transform([[1, 21], [22, 42], [43, 64]], lambda b: v[b[1]:b[2]]) AS t, list_transform([[1, 21], [22, 42], [43, 64]], lambda b: u[b[1]:b[2]]) AS w,
    list_transform(range(0, 5), lambda k: list_avg(u[k * 12 + 1:k * 12 + 12])) AS cal, list_transform(range(0, 4), lambda k: list_sum(u[k * 16 + 1:k * 16 + 16]) / list_sum(u)) AS reg FROM x),
    l AS (SELECT vec_id, list_transform(t, lambda p: list_avg(p)) AS value, [{", ".join(f"1 / (1 + list_avg(w[{h + 1}])) - 0.5::DOUBLE * list_max(w[{h + 1}]) + 0.3::DOUBLE * (list_max(t[{h + 1}]) - list_min(t[{h + 1}])) + {_SHIFTS[h]}" for h in range(3))}] AS l FROM c),
    s AS (SELECT vec_id, value, l, list_sum(list_transform(l, lambda z: exp(z))) AS total FROM l)
    SELECT vec_id, round((exp(l[1]) * value[1] + exp(l[2]) * value[2] + exp(l[3]) * value[3]) / total * (1 - 0.15::DOUBLE * (vec_id % 3)), 6) AS blended, CASE WHEN l[1] >= l[2] AND l[1] >= l[3] THEN 'long' WHEN l[2] >= l[3] THEN 'medium' ELSE 'short' END AS dominant FROM s""")
def h29_shifted_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds of each vector as three predictors, with shifts by calendar, regime and tongues."""
    size = lambda c: F.transform(c, lambda x: F.abs(x))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = lambda c: total(c) / F.size(c)

    def third(start: int, n: int):
        t = F.slice("v", start, n)
        return lambda: {"value": mean(t), "confidence": 1 / (1 + mean(size(t))), "linearity": F.array_max(size(t)), "gap": F.array_max(t) - F.array_min(t)}

    calendar = F.array(*[mean(size(F.slice("v", k * 12 + 1, 12))) for k in range(5)])
    shares = F.array(*[total(size(F.slice("v", k * 16 + 1, 16))) / total(size(F.col("v"))) for k in range(4)])
    x = vectors(spark, sf_dir).select("vec_id", "v", calendar.alias("calendar"), shares.alias("regime"), (F.col("vec_id") % 3).alias("tongues"))
    m = regimes.mix_predictors(x, {"long": third(1, 21), "medium": third(22, 21), "short": third(43, 22)}, calendar="calendar", calendar_shift=CALENDAR_SHIFT, regime="regime", regime_shift=REGIME_SHIFT, tongues="tongues")
    return m.select("vec_id", F.round("blended", 6).alias("blended"), "dominant")


@query("""SELECT user_id, event_id, round(ln(1 + value) * (1 + user_id % 7), 6) AS score FROM events""")
def k03_score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored by a function of numpy arrays."""
    import numpy as np

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("user_id") % 7).cast("double").alias("group"))
    return learning.score_batches(e, ["value", "group"], lambda a: np.log1p(a[:, 0]) * (1 + a[:, 1])).select("user_id", "event_id", F.round("score", 6).alias("score"))
