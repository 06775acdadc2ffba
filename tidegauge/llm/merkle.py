"""Merkle manifest of a dataset, with a proof of inclusion for each row, in DataFrame functions only.

Each row is a leaf; a source's leaves in order of id form one tree, and the sources' roots in order of source another.
Nodes are numbered within their tree, so a node's parent is its number over the fanout, and a level is one aggregation:
conditional aggregates spread the children of a parent over `fanout` slot columns. The slots one after another hash to
the parent; with a child's own slot left out they are its siblings. On the way down each parent hands its children the
siblings of all levels above, so no row meets its tree: a level joins parents with their own parents' lists, and the
lowest level turns the slots back into rows.

Nulls are hashed as `-`, so that a null differs from an empty text; a null id comes first in its source and is never
tampered with; a null source is a source, and comes first. Rows of one id are ordered by their hash; equal rows are
leaves of their own. A source of one row has that leaf as its root; a run of one node is hashed like any other. Long
texts are hashed once and not carried on. An empty table has no tree and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written
from tidegauge.operators.ordering import numbered

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def leaf(row: dict[str, Column]) -> Column:
    """Hash of a row's values, each as its length in bytes, a colon and itself."""
    said = [c.cast("string") for c in row.values()]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]))


def _slots(payload: list[str], fanout: int) -> list[str]:
    """Where the children's hashes are in a run."""
    return [f"_s{i}.hash" if payload else f"_s{i}" for i in range(fanout)]


def _level(nodes: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """Runs of siblings: (tree, n, number, and for each child a slot column with its hash, and its payload if any). n is
    the number of nodes on the children's level."""
    child = f"struct({', '.join(['hash', *payload])})" if payload else "hash"
    spread = [F.expr(f"max(CASE WHEN number % {fanout} = {i} THEN {child} END)").alias(f"_s{i}") for i in range(fanout)]
    return nodes.groupBy("tree", "n", F.floor(F.col("number") / fanout).alias("number")).agg(*spread)


def _parents(runs: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    slots = _slots(payload, fanout)
    whole = F.expr(f"concat_ws('', {', '.join(slots)})")
    return runs.select("tree", F.ceil(F.col("n") / fanout).alias("n"), "number", F.when(F.col("n") == 1, F.col(slots[0])).otherwise(_hash(whole)).alias("hash"))


def _children(payload: list[str], fanout: int) -> Column:
    """A run's children as structs (number, hash, path, payload); a child's path is its siblings, and then its parent's
    path. A lone node is not hashed on its way up, so it has none."""
    slots = _slots(payload, fanout)
    out = []
    for i, own in enumerate(slots):
        lhs, rhs = (f"concat_ws('', {', '.join(side)})" if side else "''" for side in (slots[:i], slots[i + 1 :]))
        more = "".join(f", _s{i}.{c} AS {c}" for c in payload)
        out.append(f"struct(number * {fanout} + {i} AS number, {own} AS hash, if(n = 1, path, concat(array(struct({lhs} AS lhs, {rhs} AS rhs)), path)) AS path{more})")
    return F.expr(f"filter(array({', '.join(out)}), c -> c.hash IS NOT NULL)")


def _climb(leaves: DataFrame, payload: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, written, and (tree, top, hash) of each tree's root, `top` being the level that ends in it.
    leaves: (tree, n, number, hash, and the payload). All trees of a level are worked on together."""
    levels, roots, nodes, kept = [], None, leaves, payload
    while True:
        runs = written(_level(nodes, kept, fanout), name)
        levels.append(runs)
        above = _parents(runs, kept, fanout)
        ended = above.where("n = 1").select("tree", F.lit(len(levels)).alias("top"), "hash")
        roots = ended if roots is None else roots.unionByName(ended)
        if runs.agg(F.max("n")).first()[0] in (None, *range(fanout + 1)):
            return levels, roots
        nodes, kept = above.where("n > 1"), []


def _descend(levels: list[DataFrame], tops: DataFrame, carried: list[str], payload: list[str], fanout: int) -> DataFrame:
    """Leaves with the siblings of all levels, from `tops`: (tree, top, path, carried columns). A path is an array of
    (lhs, rhs), the lowest level first."""
    nodes = None
    for k in range(len(levels), 0, -1):
        here = tops.where(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("number"), "path", *carried)
        above = here if nodes is None else nodes.unionByName(here)
        above = above.select(F.col("tree").alias("_tree"), F.col("number").alias("_number"), "path", *carried)
        met = levels[k - 1].join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("number") == F.col("_number")))
        nodes = met.select("tree", *carried, F.inline(_children(payload if k == 1 else [], fanout)))
        nodes = nodes.drop("hash") if k > 1 else nodes
    return nodes


def _fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, step: _hash(F.concat(step["lhs"], acc, step["rhs"])))


def manifest(rows: DataFrame, columns: list[str], id_col: str, source_col: str, tampered: Column, changed: dict[str, Column], fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row: the hash of its columns, the roots of
    its source's tree and of the whole, the hash of all its siblings from the lowest level up and from left to right, and
    the root that follows from these siblings if, where `tampered` holds, the `changed` columns are put in the row's
    place."""
    own = {c: F.col(c) for c in columns}
    other = F.when(tampered, leaf(own | changed)).alias("tampered")
    leaves = rows.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("tree"), leaf(own).alias("hash"), other)
    ranked = numbered(leaves, ["tree"], ["id", "hash"], "number", "n")
    levels, roots = _climb(ranked, ["id", "tampered"], fanout, "merkle")
    sources = numbered(roots.withColumnRenamed("tree", "source"), [], ["source"], "number", "n").withColumn("tree", F.lit(None).cast("string"))
    upper, whole = _climb(sources, ["source", "top"], fanout, "merkle-sources")
    start = whole.select("tree", "top", F.array().cast("array<struct<lhs:string,rhs:string>>").alias("path"), F.col("hash").alias("root"))
    tops = _descend(upper, start, ["root"], ["source", "top"], fanout)
    tops = written(tops.select(F.col("source").alias("tree"), "top", "path", F.col("hash").alias("subroot"), "root"), "merkle-tops")
    proved = _descend(levels, tops, ["subroot", "root"], ["id", "tampered"], fanout)
    folded = _fold(F.coalesce("tampered", "hash"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["lhs"], s["rhs"])), "")
    out = proved.select("id", F.col("hash").alias("leaf"), "subroot", "root", _hash(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`; where 5 divides the CRC-32 of the decimal id, the text's A-Z are lower-cased."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    low = {"text": F.translate("text", UPPER, LOWER)}
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", tampered, low).withColumnRenamed("id", "doc_id")
