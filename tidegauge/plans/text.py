"""Text and web queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import lexicons as lex
from tidegauge.functions import text as tx
from tidegauge.operators import joins
from tidegauge.plans.registry import query, table


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CANON = r"""canon AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS rest, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
    canon2 AS (SELECT *, regexp_extract(regexp_replace(rest, '\?.*$', ''), '^([^:/]+://[^/]*)', 1) AS front, regexp_replace(rest, '\?.*$', '') AS base, list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: NOT starts_with(p, 'utm_') AND string_split(p, '=')[1] <> '') AS kept FROM canon),
    canon3 AS (SELECT page_id, url, lower(front) || substr(base, length(front) + 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || frag AS canonical FROM canon2)"""


@query(f"WITH {_CANON} SELECT page_id, canonical, substr(md5(canonical), 1, 12) AS doc_key FROM canon3")
def h16_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs and their storage keys (A-11)."""
    c = tx.canonical_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical"), tx.doc_key(c).alias("doc_key"))


_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_TEXT}) AS digest, length({_TEXT}) AS n_chars FROM pages")
def h07_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query(f"""WITH w AS (SELECT doc_id, upper(text) AS text FROM documents), t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_$]+'), lambda x: regexp_extract(x, '^\\$?([A-Z]{{2,5}})$', 1)), lambda x: x <> '') AS found FROM w)
    SELECT doc_id, list_sort(list_distinct(list_filter(found, lambda x: NOT list_contains({_list(lex.NO_TICKERS)}, x))))::VARCHAR AS tickers FROM t WHERE false
    UNION ALL SELECT doc_id, '[' || array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda x: regexp_extract(x, '^([A-Z]{{2,5}})$', 1)), lambda x: x <> '' AND NOT list_contains({_list(lex.NO_TICKERS)}, x)))), ', ') || ']' FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents)""")
def h08_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "_")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(F.sort_array(tx.tickers(ascii_text)), ", "), F.lit("]")).alias("tickers"))


_LEX = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in lex.SENTIMENT.items())


@query(f"WITH lex(w, v) AS (VALUES {_LEX}), t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), s AS (SELECT doc_id, sum(v) AS s, count(*) AS n FROM t JOIN lex USING (w) GROUP BY 1) SELECT d.doc_id, round(CASE WHEN s IS NULL THEN 0 ELSE least(1, greatest(-1, s / sqrt(n))) END, 6) AS sentiment FROM documents d LEFT JOIN s USING (doc_id)")
def h09_lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.lexicon_sentiment(F.col("text")), 6).alias("sentiment"))


_TOK = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id, text, list_transform({_TOK}, lambda w: trim(lower(w), '.,!?;:"''()[]')) AS w FROM documents), d AS (SELECT doc_id,
    len(list_filter(w, lambda x: list_contains({_list(lex.TECHNICAL)}, x))) / greatest(len(w), 1) AS technical, len(list_filter(w, lambda x: list_contains({_list(lex.HEDGING)}, x))) / greatest(len(w), 1) AS hedging, len(list_filter(w, lambda x: list_contains({_list(lex.HYPE)}, x))) / greatest(len(w), 1) AS hype,
    len(regexp_extract_all(text, '(?i)\\[\\d+\\]|\\([A-Z][a-z]+(?:\\s+(?:et\\s+al\\.?|and|&))?,?\\s*\\d{{4}}\\)|doi:|arXiv:')) / greatest(len(regexp_extract_all(text, '[.!?]')), 1) AS citation FROM t)
    SELECT doc_id, round(technical, 6) AS technical, round(hedging, 6) AS hedging, round(hype, 6) AS hype, round(citation, 6) AS citation, CASE WHEN technical > 0.03::DOUBLE AND citation > 0.1::DOUBLE AND hype < 0.02::DOUBLE THEN 'scientific' WHEN hype > 0.03::DOUBLE AND technical < 0.02::DOUBLE THEN 'hype' ELSE 'editorial' END AS stance FROM d""")
def h10_epistemic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in tx.densities(F.col("text")).items()])
    return d.select("doc_id", *[F.round(k, 6).alias(k) for k in ("technical", "hedging", "hype", "citation")], tx.stance(F.col("technical"), F.col("citation"), F.col("hype")).alias("stance"))


@query(f"""WITH t AS (SELECT doc_id, text, len({_TOK}) AS n, greatest(len(regexp_extract_all(text, '[.!?]')), 1) AS s, greatest(strlen(text), 1) AS b FROM documents)
    SELECT doc_id, n AS n_words, s AS n_sentences, round(n / s, 6) AS words_a_sentence, round(len(regexp_extract_all(text, '[A-Z]')) / b, 6) AS upper_ratio, round(len(regexp_extract_all(text, '[0-9]')) / b, 6) AS digit_ratio, len(regexp_extract_all(text, '\\?')) AS questions, len(regexp_extract_all(text, '!')) AS exclamations FROM t""")
def h11_article_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ("words_a_sentence", "upper_ratio", "digit_ratio")
    return table(spark, sf_dir, "documents").select("doc_id", *[(F.round(c, 6) if k in rounded else c.cast("long")).alias(k) for k, c in tx.article_features(F.col("text")).items()])


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def h12_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tx.hrefs(F.col("html"))).alias("href"))


@query("""WITH h AS (SELECT page_id, html, unnest(regexp_extract_all(html, '(?is)(<h[123][^>]*>.*?</h[123]>)', 1)) AS h FROM pages) SELECT page_id, substr(h, 3, 1)::INT AS level, trim(regexp_replace(h, '(?s)<[^>]*>', '', 'g')) AS text FROM h""")
def h13_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(tx.headings(F.col("html")))).select("page_id", "level", "text")


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')), ''), 'Untitled') AS title, len(regexp_extract_all(html, '(?i)<(b|strong)(\\s[^>]*)?>')) AS bold, len(regexp_extract_all(html, '(?i)<(i|em)(\\s[^>]*)?>')) AS italic FROM pages""")
def h13_title_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tx.emphasis(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", tx.title(F.col("html")).alias("title"), e["bold_count"].cast("long").alias("bold"), e["italic_count"].cast("long").alias("italic"))


@query()
def h14_dom_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.dom_depth(F.col("html")).alias("depth"))


@query(f"WITH t AS (SELECT page_id, {_TEXT} AS t, html FROM pages) SELECT page_id, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n_words FROM t")
def h17_article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(F.split(tx.html_text(F.col("html")), " "), lambda x: x != "")).cast("long").alias("n_words"))


@query("""WITH t AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\\*\\*([^*]{3,40})\\*\\*', 1), regexp_extract_all(text, '`([^`]{2,30})`', 1))) AS c FROM documents)
    SELECT DISTINCT doc_id, regexp_replace(lower(trim(c)), '\\s+', '_', 'g') AS concept FROM t WHERE length(regexp_replace(lower(trim(c)), '\\s+', '_', 'g')) BETWEEN 3 AND 39""")
def h23_marked_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold and code concepts; Capitalised and defined ones need lookahead, which the oracle's dialect lacks."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r"\*\*([^*]{3,40})\*\*"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"`([^`]{2,30})`"), F.lit(1)))
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("c")).select("doc_id", F.regexp_replace(F.lower(F.trim("c")), r"\s+", "_").alias("concept"))
    return names.where(F.length("concept").between(3, 39)).distinct()


@query()
def h23_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.concepts(F.col("text"))).alias("concept"))


@query()
def h35_research_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in tx.research_concepts(F.col("html")).items()])


@query("""SELECT page_id, CASE WHEN s LIKE '%circuit%' OR s LIKE '%electronic%' OR s LIKE '%vlsi%' OR s LIKE '%semiconductor%' THEN 'ece' WHEN s LIKE '%biology%' OR s LIKE '%neuron%' OR s LIKE '%synapse%' OR s LIKE '%cell%' THEN 'biology'
    WHEN s LIKE '%finance%' OR s LIKE '%market%' OR s LIKE '%trading%' OR s LIKE '%economics%' THEN 'finance' WHEN s LIKE '%physics%' OR s LIKE '%mechanics%' OR s LIKE '%quantum%' THEN 'physics' ELSE 'general' END AS subject FROM (SELECT page_id, lower(url) || ' ' || lower(html) AS s FROM pages)""")
def h36_infer_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.infer_subject(F.col("url"), F.col("html")).alias("subject"))


@query()
def h40_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.summary(F.col("html")).alias("summary"))


#: Topics by words in a link, tried in order; an example for H-62.
TOPICS = [("articles", "the"), ("articles", "and"), ("romance", "la"), ("german", "sch")]


@query("""WITH l AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages), m AS (SELECT l.*, CASE WHEN contains(href, 'the') OR contains(href, 'and') THEN 'articles' WHEN contains(href, 'la') THEN 'romance' WHEN contains(href, 'sch') THEN 'german' ELSE 'misc' END AS topic FROM l)
    SELECT page_id, topic, href FROM m QUALIFY row_number() OVER (PARTITION BY page_id, topic ORDER BY href) <= 3""")
def h62_categorize_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(tx.hrefs(F.col("html"))).alias("h")).select("page_id", F.lower("h").alias("href")).distinct()
    return joins.categorize(found, ["page_id"], "href", TOPICS, 3).select("page_id", "topic", "href")


#: Words that mark the documents' languages; an example of a keyword table: (ord, domain, word).
KEYWORDS = [(0, "english", "the"), (0, "english", "of"), (0, "english", "and"), (1, "french", "le"), (1, "french", "de"), (1, "french", "et"), (2, "german", "der"), (2, "german", "und"), (2, "german", "die"), (3, "spanish", "el"), (3, "spanish", "de"), (3, "spanish", "los")]
_KEYS = ", ".join(f"({o}, '{d}', '{w}')" for o, d, w in KEYWORDS)


@query(f"""WITH k(ord, domain, word) AS (VALUES {_KEYS}), t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents), s AS (SELECT doc_id, domain, ord, count(*) AS n FROM t JOIN k USING (word) GROUP BY ALL),
    r AS (SELECT doc_id, domain FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) = 1) SELECT d.doc_id, coalesce(domain, 'unknown') AS domain FROM documents d LEFT JOIN r USING (doc_id)""")
def c06_classify_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame(KEYWORDS, "ord int, domain string, word string")
    return joins.classify_domain(table(spark, sf_dir, "documents"), keywords, "doc_id", "text", 1).select("doc_id", "domain")


@query("SELECT page_id, CASE WHEN contains(h, 'arxiv.org') THEN 'academic' WHEN contains(h, 'sec.gov') THEN 'filing' WHEN contains(h, 'reuters.com') OR contains(h, 'ft.com') THEN 'news' WHEN contains(h, 'seekingalpha.com') OR contains(h, 'motleyfool.com') THEN 'transcript' WHEN contains(h, 'finviz.com') THEN 'social' END AS parser, h AS host FROM (SELECT page_id, lower(regexp_extract(url, '^[^:/]+://([^/:?#]*)', 1)) AS h FROM pages)")
def c07_match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.source_parser(F.col("url")).alias("parser"), tx.host(F.col("url")).alias("host"))


@query(f"WITH t AS (SELECT source, text FROM documents), s AS (SELECT source, count(*) AS n, round(avg(len({_TOK})), 6) AS mean_words, count(DISTINCT md5(text)) AS n_texts FROM t GROUP BY 1) SELECT * FROM s")
def d03_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_words"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("n_texts"))


@query(f"WITH lex(w, v) AS (VALUES {_LEX}), t AS (SELECT source, doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), s AS (SELECT doc_id, least(1, greatest(-1, sum(v) / sqrt(count(*)))) AS s FROM t JOIN lex USING (w) GROUP BY 1) SELECT source, round(least(1, greatest(-1, avg(coalesce(s, 0)))), 6) AS sentiment FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1")
def d02_source_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.avg(tx.lexicon_sentiment(F.col("text"))))), 6).alias("sentiment"))


@query("""WITH u AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS top FROM pages) SELECT top, count(*) AS n, max(host) AS last_host FROM u GROUP BY 1""")
def d29_path_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("top"))
    return u.groupBy("top").agg(F.count("*").alias("n"), F.max("host").alias("last_host"))


@query("""WITH w AS (SELECT doc_id, lower(text) AS t, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents), p AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS p FROM documents),
    q AS (SELECT doc_id, count(*) AS paras, count(*) FILTER (contains(p, 'the') AND contains(p, 'and')) AS j FROM p GROUP BY 1), m AS (SELECT doc_id, j / paras AS p12, (length(t) - length(replace(t, 'the', ''))) / 3 / n AS p1, (length(t) - length(replace(t, 'and', ''))) / 3 / n AS p2 FROM w JOIN q USING (doc_id))
    SELECT doc_id, round(p12 * log2(p12 / (p1 * p2 + 1e-12::DOUBLE)), 6) AS mi FROM m WHERE p12 > 0 AND p1 > 0 AND p2 > 0 AND p12 * log2(p12 / (p1 * p2 + 1e-12::DOUBLE)) > 0.005::DOUBLE""")
def d30_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").withColumn("c1", F.lit("the")).withColumn("c2", F.lit("and"))
    return joins.concept_weights(pairs, "text", "c1", "c2", "\n").where("mi > 0.005").select("doc_id", F.round("mi", 6).alias("mi"))


def _fold_sql(digest: str, chunks: int, modulus: int) -> str:
    return f"list_reduce(list_transform(range(0, {chunks}), lambda k: ('0x' || substr({digest}, (k * 8 + 1)::INT, 8))::BIGINT), lambda a, c: (a * 4294967296 + c) % {modulus}, 0::BIGINT)"


_DIMS = f"""toks AS (SELECT DISTINCT doc_id, lang, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS t FROM documents),
    dims AS (SELECT doc_id, lang, {_fold_sql('md5(t)', 4, 997)} AS dim FROM toks UNION SELECT doc_id, lang, {_fold_sql('sha256(t)', 8, 997)} FROM toks UNION SELECT doc_id, lang, {_fold_sql('sha1(t)', 5, 332)} FROM toks)"""


def _tokens(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(by, tokens) of documents, one row for each `by`: rows that share one are put together, if there are any."""
    docs = table(spark, sf_dir, "documents")
    read = docs.select(*by, tx.tokens(F.col("text")).alias("tokens"))
    if docs.groupBy(*by).count().where("count > 1").isEmpty():
        return read
    return read.groupBy(*by).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def _places(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(by, dims), one row for each `by` that has a token: its places."""
    return _tokens(spark, sf_dir, *by).select(*by, tx.token_places(F.col("tokens"), 997).alias("dims")).where(F.size("dims") > 0)


def _lang_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, dim) of all documents, with repeats."""
    docs = table(spark, sf_dir, "documents").select("lang", tx.token_places(tx.tokens(F.col("text")), 997).alias("dims"))
    return docs.select("lang", F.explode("dims").alias("dim"))


@query(f"WITH {_DIMS} SELECT doc_id, count(*) AS n_dims, sum(dim)::BIGINT AS sum_dims, max(dim)::BIGINT AS max_dim FROM dims GROUP BY 1")
def h30_hdv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "doc_id", "lang").select("doc_id", F.explode("dims").alias("dim")).groupBy("doc_id").agg(F.count("*").alias("n_dims"), F.sum("dim").alias("sum_dims"), F.max("dim").cast("long").alias("max_dim"))


@query(f"WITH {_DIMS} SELECT dim::INT AS dim, count(DISTINCT lang) AS n_domains FROM dims GROUP BY dim HAVING count(DISTINCT lang) >= 2")
def d25_overlap_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lang_dims(spark, sf_dir).groupBy("dim").agg(F.countDistinct("lang").alias("n_domains")).where("n_domains >= 2")


@query(f"WITH {_DIMS} SELECT lang, dim::INT AS dim, count(*) AS n FROM dims GROUP BY ALL")
def d26_domain_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "doc_id", "lang").select("lang", F.explode("dims").alias("dim")).groupBy("lang", "dim").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS t FROM conversations), d AS (SELECT conv_id, {_fold_sql('md5(t)', 4, 64)} AS dim, 1 / (1 + 0.1::DOUBLE * turn) AS w FROM w)
    SELECT conv_id, dim::INT AS dim, round(least(1, sum(w)), 6) AS weight FROM d GROUP BY ALL""")
def h31_workflow_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.tokens(F.col("text"))).alias("t"))
    placed = steps.select("conv_id", tx.digest_mod(F.md5(F.col("t").cast("binary")), 32, 64).alias("dim"), (1 / (1 + 0.1 * F.col("turn"))).alias("w"))
    return placed.groupBy("conv_id", "dim").agg(F.round(F.least(F.lit(1.0), F.sum("w")), 6).alias("weight"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS t FROM documents),
    d AS (SELECT doc_id, t, {_fold_sql('md5(t)', 4, 997)} AS dim FROM t), o AS (SELECT doc_id, dim, count(*) AS owners FROM d GROUP BY ALL) SELECT doc_id, t AS token, round(sqrt(count(*) FILTER (owners = 1)), 6) AS salience FROM d JOIN o USING (doc_id, dim) GROUP BY ALL""")
def h33_token_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all tokens of each document."""
    told = _tokens(spark, sf_dir, "doc_id").where("doc_id is not null").select("doc_id", F.explode(tx.lone_tokens(F.col("tokens"), 997)).alias("t"))
    return told.select("doc_id", "t.token", F.round(F.sqrt(F.col("t.alone").cast("double")), 6).alias("salience"))
