"""Shards under a byte limit by extendible hashing.

Rows hash to 60 bits: 30 of the id's MD5, then 30 of the text's. A directory is indexed by a hash prefix; a bucket over
the limit is split on its next bit, others stay whole, until every bucket fits. The directory is built from the sizes
of small cells of the hash space (pre-aggregated before the shuffle), each cell finds the first depth at which its
bucket fits, and only cells that are still too large are cut into finer ones, from their own rows.

A row that is larger than the limit is alone in its shard or with rows of the very same hash, and `oversize`. Rows with
equal id and text have equal hashes, so no bit parts them: a bucket of them at full depth is cut by counting copies.
Null and empty texts have 0 bytes; a null id hashes as an empty string. Other columns are not read; an empty table has
no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

BITS, STEP = 60, 8


def _top30(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(0xFFFFFFFF)


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, h) of every row, and the columns `keep`."""
    return docs.select(
        *(keep or []),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.shiftleft(F.shiftright(_top30(F.col(id_col).cast("string")), 2), 30).bitwiseOR(F.shiftright(_top30(F.col(text_col).cast("string")), 2)).alias("h"),
    )


def _prefix(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def _fit(cells: DataFrame, at: int, least: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_docs): for each cell of depth `at`, the bucket it falls into, the first of depth
    `least` or more whose rows fit; no depth where not even the cell fits."""
    up = cells.select("*", F.explode(F.sequence(F.lit(least), F.lit(at))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(cell, {at} - depth)"))
    sizes = up.groupBy("depth", "bucket").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
    fits = up.join(sizes, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("f"))
    return cells.join(fits, "cell", "left").select("cell", "b", "n", "f.depth", "f.shard_bytes", "f.shard_docs")


def shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversize) of every row. shard is the bucket's hash prefix
    as binary digits ('' for depth 0), with a number behind it where copies had to be counted apart. The hash h, which
    `write_shards` needs, is given if asked for."""
    rows = written(hashed(docs, id_col, text_col), "hashed")
    total = rows.agg(F.sum("n_bytes").alias("b")).first().b or 0
    at = min(BITS, max(STEP, math.ceil(math.log2(max(1, total) / limit_bytes)) + 6)) if total > limit_bytes else 1
    least, placed, rest = 0, [], rows
    while True:
        cells = written(_fit(rest.groupBy(_prefix(at).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), at, least, limit_bytes), "cells")
        fit = cells.where("depth is not null").select("cell", "depth", "shard_bytes", "shard_docs")
        placed.append(rest.withColumn("cell", _prefix(at)).join(fit, "cell").withColumn("part", F.lit(None).cast("long")))
        over = cells.where("depth is null").select("cell")
        if over.isEmpty():
            break
        rest = rest.withColumn("cell", _prefix(at)).join(over, "cell", "left_semi").select("doc_id", "n_bytes", "h")
        if at == BITS:
            placed.append(_copies(rest, limit_bytes))
            break
        least, at = at + 1, min(BITS, at + STEP)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"lpad(bin(shiftright(h, {BITS} - depth)), depth, '0')"))
    return out.select("doc_id", "n_bytes", F.concat(name, F.coalesce(F.concat(F.lit("-"), "part"), F.lit(""))).alias("shard"), "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversize"), *(["h"] if with_hash else []))


def _copies(rows: DataFrame, limit: int, block: int = 10_000) -> DataFrame:
    """Rows of one hash that do not fit together, dealt out by counting: they are copies of each other. A row that is alone
    has no part's number."""
    same = rows.groupBy("h", "doc_id", "n_bytes").agg(F.count("*").alias("copies"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    blocks = same.withColumn("room", room).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))).alias("k")).repartition("h", "k")
    each = blocks.select("*", F.explode(F.expr(f"sequence(k * {block}, least(copies, (k + 1) * {block}) - 1)")).alias("i")).withColumn("part", F.expr("i div room"))
    here = F.least(F.col("room"), F.col("copies") - F.col("part") * F.col("room"))
    return each.select("doc_id", "n_bytes", "h", F.lit(BITS).alias("depth"), (here * F.col("n_bytes")).alias("shard_bytes"), here.alias("shard_docs"), F.when(F.col("copies") > F.col("room"), F.col("part")).alias("part"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of `docs` as one folder for each shard of `placed` (with its hashes). Rows are dealt by shard, so that a shard is
    one task's file. Every row has its own shard: rows of one hash and size are copies of each other, and the k-th of
    them here takes the place of the k-th there; null ids and texts hash as in `shards`."""
    cols, key = docs.columns, ["_h", "_b", "_null"]
    own = F.struct(*[docs[c] for c in cols])
    rows = hashed(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), own.alias("_row")), "_i", "_t", keep=["_row"])
    rows = rows.select("_row", F.col("h").alias("_h"), F.col("n_bytes").alias("_b"), F.col("doc_id").isNull().alias("_null"))
    # where all places of a key are one shard, no counting is needed
    spots = placed.select(F.col("h").alias("_h"), F.col("n_bytes").alias("_b"), F.col("doc_id").isNull().alias("_null"), F.col("shard").alias("_shard")).groupBy(*key, "_shard").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*key).orderBy("_shard")
    spots = spots.withColumn("_end", F.sum("_n").over(upto)).withColumn("_from", F.col("_end") - F.col("_n")).withColumn("_parts", F.count("*").over(Window.partitionBy(*key)))
    alone, dealt = spots.where("_parts = 1").select(*key, "_shard"), spots.where("_parts > 1")
    one = rows.join(alone, key).select("_row", "_shard")
    many = rows.join(dealt.select(*key).distinct(), key, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    many = many.join(dealt, key).where("_k > _from and _k <= _end").select("_row", "_shard")
    out = one.unionByName(many).select(*[F.col("_row")[c].alias(c) for c in cols], F.concat(F.lit("s"), "_shard").alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
