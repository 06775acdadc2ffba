"""Shards against their SQL, with texts over the limit alone and with copies."""

import duckdb
from oracle import assert_same

from tidegauge.llm import queries


def test_fine_shards_equal_their_sql(spark, tmp_path):
    limit = queries.FINE_SHARD_BYTES
    texts = [(1, "x" * (limit + 1)), *[(2, "y" * (limit // 3))] * 7, *[(3, "z" * (limit + 5))] * 2, *[(i, "w" * (200 * i)) for i in range(10, 60)], (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["extendible_shards_fine"](spark, str(tmp_path))
    assert_same(got, c, queries.ORACLES["extendible_shards_fine"])
    shards = {r.doc_id: r.shard for r in got.collect()}
    assert "-" not in shards[1] and "-" in shards[2] and "-" in shards[3]
