import hashlib
import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidegauge.functions import calendar as cal
from tidegauge.functions import spectral
from tidegauge.functions import text as tx
from tidegauge.operators import graph, joins, relations, windows
from tidegauge.operators import calendar as cal_ops
from tidegauge.operators import statistics as st


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_third_fridays(spark):
    r = one(spark, cal.third_friday(F.lit(2024), F.lit(3)).alias("a"), cal.third_friday(F.lit(2024), F.lit(1)).alias("b"))
    assert (r.a, r.b) == (date(2024, 3, 15), date(2024, 1, 19))


def test_trading_days_equal_a_walk(spark):
    days = [date(2024, 1, 1) + timedelta(k) for k in range(0, 40, 3)]
    rows = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date").select("a", "b", cal.trading_days(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        lo, hi = min(r.a, r.b), max(r.a, r.b)
        walk = sum((lo + timedelta(k)).weekday() < 5 for k in range(1, (hi - lo).days + 1))
        assert r.n == (walk if r.b >= r.a else -walk)


def test_options_amplitude_is_one_on_expiry_and_bounded(spark):
    rows = cal_ops.phases(spark.createDataFrame([(date(2024, 3, 15),), (date(2024, 3, 3),)], "d date")).collect()
    assert rows[0].amplitudes[2] == 1.0
    assert all(0 <= a <= 1 and 0 <= t < 2 * math.pi for r in rows for a, t in zip(r.amplitudes, r.theta, strict=True))


def test_no_events_give_pi_and_zero(spark):
    none = spark.createDataFrame([], "kind string, d date, ord int")
    r = cal_ops.nearest_event_phase(spark.createDataFrame([(date(2024, 1, 2),)], "d date"), none, "fed").first()
    assert (r.theta, r.amplitude) == (math.pi, 0.0)


def test_tickers_and_sentiment(spark):
    r = one(spark, tx.tickers(F.lit("$AAPL and $AAPL beat MSFT, THE CEO said")).alias("t"), tx.tickers(F.lit("$F rose"), cashtags_only=True).alias("c"), tx.lexicon_sentiment(F.lit("buy buy sell")).alias("s"))
    assert r.t == ["AAPL", "MSFT"] and r.c == ["F"] and abs(r.s - 0.6 / math.sqrt(3)) < 1e-12


def test_context_sentiment(spark):
    r = one(spark, tx.ticker_context_sentiment(F.lit("profit at AAPL today. " + "x" * 80 + " loss"), F.lit("AAPL")).alias("s"))
    assert r.s > 0


def test_html_tables_headers(spark):
    html = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    r = one(spark, tx.html_tables(F.lit(html)).alias("a"), tx.html_tables(F.lit(html), header=False).alias("b"))
    assert r.a == [[["a"], ["1"]]] and r.b == [[["1"]]]


def test_transcripts_and_filings(spark):
    t, n = tx.parse_transcript(F.lit("We expect growth. EPS of $1.20 on $3.5 billion. Question and Answer: hi")), tx.parse_transcript(F.lit("No such part."))
    r = one(spark, *[c.alias(k) for k, c in t.items()], n["qa_section"].alias("empty"))
    assert r.qa_section.startswith("Question and Answer") and r.guidance == ["We expect growth."] and r.empty == "" and r.eps_mentions and r.revenue_mentions
    f = tx.parse_filing(F.lit("Form 8-K report Item 2.02 results $5 million up 12%"), F.lit("https://x.org/doc"))
    r = one(spark, *[c.alias(k) for k, c in f.items()])
    assert (r.filing_type, r.event_type) == ("8-K", "Item 2.02") and len(r.key_figures) == 2


def test_equations(spark):
    r = one(spark, tx.equations(F.lit(r"a \begin{equation} x^2 + y = 1 \end{equation} $$ab$$ \[ \sin x = y \]")).alias("e"), tx.equation_type(F.lit(r"\sin x")).alias("k"), tx.is_equation_noise(F.lit(r"\label{a}")).alias("n"))
    assert r.e == ["x^2 + y = 1", r"\sin x = y"] and r.k == "trigonometric" and r.n


def test_urls_ids_and_links(spark):
    r = one(spark, tx.canonical_url(F.lit("HTTPS://Ex.COM/Path?utm_a=1&b=2&=3#f")).alias("u"), tx.arxiv_id(F.lit("https://arxiv.org/abs/2602.13213v2")).alias("i"), tx.markdown_links(F.lit("[a b](http://x/y.PDF)")).alias("m"), tx.dependencies(F.lit("numpy>=1\nscipy\n")).alias("d"))
    assert r.u == "https://ex.com/Path?b=2#f" and r.i == "2602.13213" and tuple(r.m[0]) == ("a b", "http://x/y.PDF", "pdf") and r.d == ["numpy", "scipy"]


def test_dom_depth_and_summary(spark):
    r = one(spark, tx.dom_depth(F.lit("<div><p>a<br>b</p></div>")).alias("d"), tx.summary(F.lit("<p>short</p><p>" + "long " * 20 + "</p>")).alias("s"))
    assert r.d == 3 and r.s.startswith("long")


def test_hash_places_equal_big_integers(spark):
    for w in ("abc", "größe"):
        r = one(spark, tx.token_dims(F.lit(w), 10_000).alias("d"))
        big = lambda h: int(h(w.encode()).hexdigest(), 16)
        assert r.d == [big(hashlib.md5) % 10_000, big(hashlib.sha256) % 10_000, big(hashlib.sha1) % 3333]


def test_best_rational_and_spectra(spark):
    spec = F.array(F.struct(F.lit(-0.5).alias("re"), F.lit(0.2).alias("im")), F.struct(F.lit(0.95).alias("re"), F.lit(0.0).alias("im")))
    inv = spectral.invariants(spec, 3)
    r = one(spark, spectral.best_rational(F.lit(1.5)).alias("b"), spectral.hurwitz_margin(spec).alias("m"), inv["radius"].alias("r"), inv["n_slow"].alias("n"), inv["top_re"].alias("t"))
    assert tuple(r.b) == (3, 2) and r.m == 0.95 and r.r == 0.95 and r.n == 1 and r.t == [0.95, -0.5, 0.0]


def test_sma_and_ema_of_a_constant_across_chunks(spark):
    rows = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.lit(2.0).alias("x"))
    assert {r.sma for r in windows.sma(rows, ["k"], "t", "x", 5).collect()} == {2.0}
    out = windows.linear_recurrence(rows.withColumn("x", F.col("t").cast("double")), ["k"], "t", "x", 0.8, 0.2, "y", chunk=7).orderBy("t").collect()
    y = 0.0
    for r in out:
        y = r.x if r.t == 0 else 0.8 * y + 0.2 * r.x
        assert abs(r.y - y) < 1e-9


def test_edmd_of_a_linear_system_with_a_skewed_operator(spark):
    k = [[0.9, 0.2], [0.0, 0.7]]
    x, rows = [1.0, 0.5], []
    for t in range(30):
        rows.append(("s", t, list(x)))
        x = [x[0] * k[0][0] + x[1] * k[1][0], x[0] * k[0][1] + x[1] * k[1][1]]
    fit = st.edmd_fit(spark.createDataFrame(rows, "s string, t int, x array<double>"), "s", "t", "x", 1).first()
    assert fit.error < 1e-6 and any(abs(e - 0.9) < 1e-6 for e in fit.re)


def test_skyline_equals_brute_force(spark):
    pts = [(i, float((i * 37) % 50), float((i * 91) % 47)) for i in range(120)]
    got = {r.i for r in st.skyline(spark.createDataFrame(pts, "i int, a double, b double"), "i", ["a"], ["b"]).collect()}
    want = {i for i, a, b in pts if not any(x <= a and y >= b and (x < a or y > b) for _, x, y in pts)}
    assert got == want


def test_universals_equal_brute_force(spark):
    sets = [(i, "d%d" % (i % 3), sorted({(i * k) % 23 for k in range(1, 7)})) for i in range(1, 40)]
    got = {(r.a, r.b) for r in joins.find_universals(spark.createDataFrame(sets, "pattern_id long, dimension string, dims array<int>"), 0.6).collect()}
    want = {(a, b) for a, da, x in sets for b, db, y in sets if da < db and len(set(x) & set(y)) / math.sqrt(len(x) * len(y)) >= 0.6 - 1e-12}
    assert got == want


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0), (4, 5, 1.0)], "src long, dst long, cost double")
    assert {(r.node, r.distance) for r in graph.shortest_path(e, 1).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    assert {r.node for r in graph.cycles(e).collect()} == {1, 2, 3}
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_library_dims_and_discoveries(spark):
    lib = relations.build_library(spark.createDataFrame([(1, "p", "a", "x = 1"), (2, "q", "b", "x=1"), (3, "q", "b", "y=2")], "ord int, paper_id string, domain string, latex string"))
    assert {(r.canonical, tuple(r.domains)) for r in lib.collect()} == {("x=1", ("a", "b")), ("y=2", ("b",))}
    dims = relations.assign_dims(lib, "canonical", F.col("canonical") == "y=2", F.when(F.size("domains") > 1, 5).otherwise(1), buckets=2)
    assert {(r.canonical, r.first_dim) for r in dims.collect()} == {("y=2", 0), ("x=1", 1)}
    p = spark.createDataFrame([(1, "i", 0.0, 0.0, 1.0), (2, "j", 0.0, 0.0, 2.0), (3, "i", 5.0, 5.0, 1.0)], "id long, instance string, x double, y double, value double")
    c = spark.createDataFrame([("i", 0.0, 0.0), ("j", 0.05, 0.0)], "instance string, cx double, cy double")
    assert {r.id for r in relations.merge_discoveries(p, c).collect()} == {2, 3}


def test_upsert(spark):
    schema = "id long, k1 double, k2 double, k3 double, spec array<double>, improvement double, n_obs long"
    mem = spark.createDataFrame([(1, 0.0, 0.0, 0.0, [1.0, 0.0], 0.1, 1)], schema)
    new = spark.createDataFrame([(2, 0.01, 0.0, 0.0, [1.0, 0.1], 0.5, 1), (3, 9.0, 0.0, 0.0, [1.0, 0.1], 0.5, 1)], schema)
    assert {(r.id, r.n_obs, r.improvement) for r in joins.merge_experience(mem, new).collect()} == {(1, 2, 0.5), (3, 1, 0.5)}


def test_table_functions(spark):
    from tidegauge.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, '<h1>Top <b>x</b></h1><a href="/a">a</a><a href="/b">b</a>', r"so \[ E = m c^2 \] and \[x\]")], "id int, html string, body string").createOrReplaceTempView("pages_in")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT id, href FROM pages_in, LATERAL page_links(html)") == [(1, "/a"), (1, "/b")]
    assert rows("SELECT position, level, heading FROM pages_in, LATERAL page_headings(html)") == [(0, 1, "Top  x")]
    assert rows("SELECT equation FROM pages_in, LATERAL display_equations(body)") == [("E = m c^2",)]
    assert rows("SELECT position, token FROM text_tokens(' A  b ')") == [(0, "a"), (1, "b")]
