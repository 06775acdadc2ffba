"""Joins, set operations and graphs over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators import graph, joins, relations
from tidegauge.operators import statistics as st
from tidegauge.operators.blocks import parts_for
from tidegauge.operators.store import written
from tidegauge.plans.registry import query, table
from tidegauge.plans.statistics import _RAT


@query("""WITH t AS (SELECT c_mktsegment AS symbol, stddev_pop(o_totalprice) / avg(o_totalprice) AS v, avg(o_totalprice) / 200000 AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT a.symbol AS a, b.symbol AS b, a.m - b.m AS corr FROM t a JOIN t b ON a.symbol < b.symbol),
    x AS (SELECT a AS i, b AS j, -10 * corr AS g FROM e UNION ALL SELECT b, a, -10 * corr FROM e UNION ALL SELECT a, a, 10 * abs(corr) FROM e UNION ALL SELECT b, b, 10 * abs(corr) FROM e UNION ALL SELECT symbol, symbol, 100 * v FROM t) SELECT i, j, round(sum(g), 6) AS g FROM x GROUP BY ALL""")
def c12_market_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_mktsegment").alias("symbol")).agg((F.stddev_pop("o_totalprice") / F.avg("o_totalprice")).alias("volatility"), (F.avg("o_totalprice") / 200000).alias("m"))
    e = t.alias("a").join(t.alias("b"), F.col("a.symbol") < F.col("b.symbol")).select(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b"), (F.col("a.m") - F.col("b.m")).alias("corr"))
    return joins.market_laplacian(t, e).select("i", "j", F.round("g", 6).alias("g"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS sector FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def c12_same_sector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    return joins.same_sector_pairs(t).select("a", "b", "sector")


@query("""WITH r AS (SELECT o_orderkey AS q, o_orderpriority AS domain, o_orderstatus AS operation FROM orders), c AS (SELECT DISTINCT o_orderpriority AS domain, o_orderstatus AS operation, o_orderpriority || o_orderstatus AS name, length(o_orderpriority) * 1.0::DOUBLE AS energy FROM orders WHERE o_orderstatus <> 'P'),
    m AS (SELECT q, CASE WHEN r.operation = c.operation THEN 0 ELSE 1 END AS tier, energy, name FROM r JOIN c USING (domain)) SELECT q, tier, energy, name FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY tier, energy, name) = 1""")
def c09_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("operation"))
    c = r.where("operation <> 'P'").select("domain", "operation").distinct().withColumn("name", F.concat("domain", "operation")).withColumn("energy", F.length("domain").cast("double"))
    return joins.best_match(r, c, "q").select("q", "tier", "energy", "name")


@query("WITH s AS (SELECT c_custkey, c_acctbal / 10000 AS b FROM customer), o AS (SELECT o_custkey, o_orderkey, least(1, o_totalprice / 400000) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT c_custkey AS symbol, round(least(1, greatest(-1, b * 0.7::DOUBLE ** coalesce(max(n), 0) + coalesce(sum(0.3::DOUBLE * s * 0.7::DOUBLE ** (n - i)), 0))), 6) AS sentiment FROM s LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey, b")
def c08_inject_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_acctbal") / 10000).alias("sentiment"))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("ord"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("score"))
    return joins.inject_sentiment(t, s).select("symbol", F.round("sentiment", 6).alias("sentiment"))


@query(f"""WITH a AS (SELECT p_brand AS name, p_type AS domain, avg(p_retailprice) AS w FROM part GROUP BY ALL), q AS (SELECT p_partkey AS q, p_type AS domain, p_retailprice AS w FROM part),
    m AS (SELECT q, name, q.w AS wq, a.w AS wa, abs(q.w - a.w) AS far, (a.domain <> q.domain)::INT AS other FROM q, a), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY other, far, name) = 1), r(p, q) AS (VALUES {_RAT})
    SELECT b.q, any_value(name) AS name, round(any_value(far), 6) AS distance, round(1 - any_value(far) / 50, 6) AS confidence, arg_min(r.p || ':' || r.q, (abs(wq / wa - r.p / r.q::DOUBLE), r.p + r.q, r.p || ':' || r.q)) AS ratio FROM b, r WHERE far < 50 GROUP BY b.q""")
def c10_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    atlas = p.groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("domain")).agg(F.avg("p_retailprice").alias("w"))
    q = p.select(F.col("p_partkey").alias("q"), F.col("p_type").alias("domain"), F.col("p_retailprice").alias("w"))
    return joins.recognize(q, atlas, 50.0).select("q", "name", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"), "ratio")


@query("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def a10_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return joins.incremental(o, o.where("o_orderstatus = 'F'"), "o_custkey").select("o_custkey")


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def g01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g02_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct())


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def g03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL")
def g04_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)")
def d46_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT p_brand || '_' || p_partkey AS id, p_partkey FROM part) SELECT string_split(id, '_')[1] AS prefix, count(*) AS total, count(l_partkey) AS covered, round(count(l_partkey) / count(*) * 100, 6) AS percent FROM r LEFT JOIN p ON l_partkey = p_partkey GROUP BY 1")
def d23_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_brand", "p_partkey").alias("id"), "p_partkey")
    hit = ids.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    return st.coverage(hit, ids, "id").select("prefix", "total", "covered", F.round("percent", 6).alias("percent"))


@query("SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) < 5")
def d24_sparse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sparse_groups(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", 5)


@query("WITH g AS (SELECT user_id, var_pop(value / 500) AS v, count(DISTINCT event_type) AS d, bool_and(value > 1) AS c FROM events GROUP BY 1) SELECT user_id, CASE WHEN v > 0.1::DOUBLE OR d < 3 OR NOT c THEN 'statistical' ELSE 'deterministic' END AS kind FROM g")
def b09_classify_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.classify_pattern(table(spark, sf_dir, "events").withColumn("x", F.col("value") / 500), "user_id", "x", "event_type", F.col("value") > 1).select("user_id", "kind")


_LINKS = "w AS (SELECT -1 - l_suppkey AS a, l_partkey AS b, min(l_quantity)::DOUBLE AS cost FROM lineitem GROUP BY ALL), e AS (SELECT a AS src, b AS dst, cost FROM w UNION ALL SELECT b, a, cost FROM w)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (below zero) and parts of all line items, both ways; the smallest quantity is the cost."""
    li = table(spark, sf_dir, "lineitem")
    w = li.select((-1 - F.col("l_suppkey")).alias("a"), F.col("l_partkey").alias("b"), "l_quantity").repartition(parts_for(li), "a", "b").groupBy("a", "b").agg(F.min("l_quantity").cast("double").alias("cost"))
    return w.select(F.col("a").alias("src"), F.col("b").alias("dst"), "cost").union(w.select("b", "a", "cost"))


_NEXT = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE src <> dst)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and those that follow them in an order, once for each time."""
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by_order).alias("dst"))
    return li.where("src <> dst")


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and those that follow them in an order."""
    return _steps(spark, sf_dir).distinct()


@query(f"WITH RECURSIVE {_LINKS}, b(node, hops) USING KEY (node) AS (SELECT -1::BIGINT, 0 UNION SELECT dst, min(b.hops) + 1 FROM b JOIN e ON src = b.node LEFT JOIN recurring.b r ON r.node = dst WHERE r.node IS NULL GROUP BY dst) SELECT node, hops FROM b")
def i02_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from supplier 0 to all suppliers and parts."""
    return graph.bfs(_links(spark, sf_dir), -1)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_quantity::BIGINT * 100000 + l_partkey % 24 AS node, l_partkey % 24 AS p, l_quantity::BIGINT AS q FROM lineitem), e AS (SELECT x.node AS src, y.node AS dst FROM n x JOIN n y ON abs(x.p * y.q - y.p * x.q) = 1),
    b(node, hops) USING KEY (node) AS (SELECT 100000::BIGINT, 0 UNION SELECT dst, min(b.hops) + 1 FROM b JOIN e ON src = b.node LEFT JOIN recurring.b r ON r.node = dst WHERE r.node IS NULL GROUP BY dst) SELECT node, hops FROM b""")
def i02_fraction_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from 0/1 over neighbouring fractions, of parts' keys modulo 24 over quantities, of all line items."""
    p, q = F.col("l_partkey") % 24, F.col("l_quantity").cast("long")
    nodes = table(spark, sf_dir, "lineitem").select((q * 100000 + p).alias("node"), p.alias("p"), q.alias("q")).distinct()
    return graph.bfs(graph.fraction_edges(nodes), 100000)


@query(f"WITH RECURSIVE {_LINKS}, b(node, distance) USING KEY (node) AS (SELECT -1::BIGINT, 0::DOUBLE UNION SELECT dst, min(b.distance + cost) FROM b JOIN e ON src = b.node LEFT JOIN recurring.b r ON r.node = dst WHERE r.node IS NULL OR b.distance + cost < r.distance GROUP BY dst) SELECT node, distance FROM b")
def i01_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(_links(spark, sf_dir), -1).select("node", "distance")


@query()
def i03_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected parts; the closure that SQL would take has the square of the parts as rows."""
    return graph.cycles(_steps(spark, sf_dir))


@query(f"WITH {_NEXT}, n AS (SELECT p_partkey AS node, p_size <= 48 AS known FROM part), u AS (SELECT DISTINCT dst FROM e JOIN n ON src = node WHERE NOT known) SELECT n.node, count(e.dst) AS out_degree FROM n LEFT JOIN e ON e.src = n.node WHERE NOT known AND n.node NOT IN (SELECT dst FROM u) GROUP BY 1")
def i05_ready_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return graph.ready_concepts(parts.select("node"), _next(spark, sf_dir), parts.where("p_size <= 48").select("node"))


@query(f"WITH {_LINKS} SELECT (SELECT count(*) FROM (SELECT a FROM w UNION SELECT b FROM w)) AS nodes, (SELECT count(*) FROM w) AS edges, round((SELECT count(DISTINCT a) FROM w) / (SELECT count(*) FROM (SELECT a FROM w UNION SELECT b FROM w)), 6) AS share")
def d50_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = written(_links(spark, sf_dir), "links")
    nodes = e.select(F.col("src").alias("node")).distinct().withColumn("kind", F.when(F.col("node") < 0, "supplier").otherwise("part"))
    return relations.graph_summary(nodes, e, "kind", "supplier").select("nodes", "edges", F.round("share", 6).alias("share"))
