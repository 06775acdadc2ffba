"""Row-multiplying extractors as table functions for SQL, made of Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameter, columns, and the query of each function.
FUNCTIONS = [
    ("page_links", "html STRING", "href STRING", r"""SELECT explode(regexp_extract_all(html, r'href="([^"]*)"', 1))"""),
    ("page_headings", "html STRING", "position INT, level INT, heading STRING", r"""SELECT pos, CAST(substring(tag, 3, 1) AS INT), trim(regexp_replace(tag, '<[^>]+>', ' ')) FROM (SELECT posexplode(regexp_extract_all(html, r'(?is)(<h[123][^>]*>.*?</h[123]>)', 1)) AS (pos, tag))"""),
    ("text_tokens", "body STRING", "position INT, token STRING", r"""SELECT posexplode(filter(split(lower(trim(body)), r'\s+'), t -> t <> ''))"""),
    ("display_equations", "latex STRING", "equation STRING", r"""SELECT explode(filter(transform(regexp_extract_all(latex, r'(?s)\\\[(.*?)\\\]', 1), e -> trim(e)), e -> length(e) > 3))"""),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: SELECT p.page_id, l.href FROM pages p, LATERAL page_links(p.html) l."""
    for name, parameter, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS TABLE ({columns}) RETURN {body}")
