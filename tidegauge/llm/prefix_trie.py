"""A trie of conversation prefixes by collapsing whole sequences.

A prefix is known by its depth and four sums of 32 bits of SHA-256 over (position, role, text) of its turns. Sums run over
blocks of turns, so a conversation of any length is many tasks; two prefixes of one depth are taken as equal if all four
sums are (about 128 bits).

Equal conversations become one weighted sequence, with the list of who ends there. Sequences that are proper prefixes of
others fall out by an anti-join against nodes that go on; the rest are the leaves. All that a node says of its subtree is
then a sum over the weighted sequences that pass it, so no tree is walked: a sequence owns those nodes whose smallest
member it is, which are its deepest ones, and everything that counts nodes once is counted by its owner. Joins of
sequences with their turns carry the block of turns in their key. Keys that many share meet only as partial sums.

Turns come in order of turn, null first, then of a digest of role and text; equal turns are turns of their own. Null role
or text is empty. Rows without conv_id belong to no conversation and are left out. Conversations that lose all turns are
members of the root. An empty table has no root. Long texts are hashed once. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, written
from tidegauge.operators.ordering import numbered

BLOCK = 4096
#: Conversations share their beginning with the first one of their hundred; how much of it is CRC-32 of the id modulo 6.
FAMILY, MOST_SHARED = 100, 6
SUMS = ["p0", "p1", "p2", "p3"]
OWN = ["q0", "q1", "q2", "q3"]
#: Bytes of ids that a task joins before it passes them on.
CHUNK_BYTES = 1 << 16


def _per_block(df: DataFrame, last: Column) -> DataFrame:
    """A row for each block of turns up to `last`."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK).cast("long"))))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ordinal, n_own, digest, chars)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return numbered(slim, ["conv_id"], ["turn", "digest"], "ordinal", "n_own").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation with its beginning taken from its family's first, as (conv_id, depth, n,
    digest, chars), and (conv_id, n) of all, turnless ones too."""
    shared = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % MOST_SHARED
    convs = turns.where("ordinal = 0").select("conv_id", "n_own", shared("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    heads = convs.where("conv_id = head").select(F.col("conv_id").alias("head"), F.col("n_own").alias("n_head"))
    convs = convs.join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = written(convs.select("conv_id", "head", "n_own", "h", "k", (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")), "trie-conversations")
    first = turns.where((F.col("ordinal") < MOST_SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("head"), "ordinal", "digest", "chars")
    begun = first.join(convs, "head").where("ordinal < k").select("conv_id", (F.col("ordinal") + 1).alias("depth"), "n", "digest", "chars")
    later = turns.where(F.col("ordinal") >= shared("conv_id")).withColumn("block", F.floor(F.col("ordinal") / BLOCK))
    kept = later.join(_per_block(convs.select("conv_id", "h", "k", "n", "n_own"), F.col("n_own")).drop("n_own"), ["conv_id", "block"])
    kept = kept.select("conv_id", (F.col("ordinal") - F.col("h") + F.col("k") + 1).alias("depth"), "n", "digest", "chars")
    return begun.unionByName(kept), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with the prefix that ends in each: its sums, this turn's part of them, and the characters up to it."""
    at = F.sha2(F.encode(F.concat_ws(":", "depth", "digest"), "UTF-8"), 256)
    part = [F.conv(F.substring("at", 8 * i + 1, 8), 16, 10).cast("long").alias(q) for i, q in enumerate(OWN)]
    rows = written(turns.withColumn("at", at).select("conv_id", "depth", "n", "chars", F.floor(F.col("depth") / BLOCK).alias("block"), *part), "trie-turns")
    names = dict(zip([*OWN, "chars"], [*SUMS, "upto"], strict=True))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("n") >= BLOCK).groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"_{p}") for c, p in names.items()])
    blocks = blocks.select("conv_id", "block", *[F.sum(f"_{p}").over(before).alias(f"_{p}") for p in names.values()])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(p) for c, p in names.items()])
    found = local.join(blocks, ["conv_id", "block"], "left").withColumns({p: F.col(p) + F.coalesce(f"_{p}", F.lit(0)) for p in names.values()})
    return written(found.drop(*[f"_{p}" for p in names.values()]), "trie-prefixes")


def ending(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, sums, upto): where each conversation ends."""
    none = convs.where("n = 0").select("conv_id", "n", *[F.lit(0).cast("long").alias(p) for p in SUMS], F.lit(0).cast("long").alias("upto"))
    return found.where("depth = n").select("conv_id", "n", *SUMS, "upto").unionByName(none)


def _joined_ids(batches):
    """Runs of ids of one sequence, joined by commas, up to some length."""
    key, ids, size = None, [], 0

    def out():
        return pa.RecordBatch.from_pylist([{"n": key[0], **dict(zip(SUMS, key[1:], strict=True)), "first": ids[0], "ids": ",".join(map(str, ids))}], _CHUNKS)

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("n", *SUMS)], 1)
        conv = b.column("conv_id").to_pylist()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(conv)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            this = tuple(keys[lo].tolist())
            if key is not None and (this != key or size > CHUNK_BYTES):
                yield out()
                ids, size = [], 0
            key = this
            ids += conv[lo:hi]
            size += 12 * (hi - lo)
    if key is not None:
        yield out()


_CHUNKS = pa.schema([(c, pa.int64()) for c in ("n", *SUMS, "first")] + [("ids", pa.string())])


def _hashed_ids(batches):
    """SHA-256 of each sequence's runs of ids, one after another."""
    key, sha = None, None
    schema = pa.schema([(c, pa.int64()) for c in ("n", *SUMS)] + [("ends_sha256", pa.string())])
    for b in batches:
        done = []
        for r in b.to_pylist():
            this = tuple(r[c] for c in ("n", *SUMS))
            if this != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = this, hashlib.sha256(r["ids"].encode())
            else:
                sha.update(b"," + r["ids"].encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest()), strict=True))], schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(n, sums, ends_sha256): lower-case SHA-256 of the ids that end in each sequence, in order, joined by commas. Ids are
    joined in ranges first, so the task of a much-repeated sequence reads few rows and holds one at a time."""
    key = ["n", *SUMS]
    dealt = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = map_batches(dealt, _joined_ids, ", ".join(f"{c} long" for c in (*key, "first")) + ", ids string")
    whole = chunks.repartition(*key).sortWithinPartitions(*key, "first")
    return map_batches(whole, _hashed_ids, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


def trie(found: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node, from `prefixes` and (conv_id, n) of all conversations: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    ends = written(ending(found, convs), "trie-ends")
    sequences = written(ends.groupBy("n", *SUMS).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.max("upto").alias("total")), "trie-sequences")
    own = _per_block(sequences.select("conv_id", "weight", "total", "n"), F.col("n")).drop("n")
    passed = found.join(own, ["conv_id", "block"]).select("conv_id", "block", "depth", "n", "weight", "total", "chars", (F.col("upto") - F.col("chars")).alias("before"), *SUMS, *OWN)
    zero = F.lit(0).cast("long")
    root = sequences.select("conv_id", zero.alias("block"), zero.alias("depth"), "n", "weight", "total", zero.alias("chars"), zero.alias("before"), *[zero.alias(c) for c in (*SUMS, *OWN)])
    passed = written(passed.unionByName(root), "trie-passed")
    node = ["depth", *SUMS]
    nodes = written(passed.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.max("n").alias("longest"), F.max("before").alias("before")), "trie-nodes")

    going_on = nodes.where("longest > depth").select(F.col("depth").alias("n"), *SUMS)
    leaves = sequences.join(going_on, ["n", *SUMS], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min(F.col("depth")).alias("owns"), F.min("before").alias("owns_before"))  # both grow along a sequence
    facts = sequences.select("conv_id", "n").join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    facts = _per_block(facts, F.col("n")).drop("n")
    met = passed.join(facts, ["conv_id", "block"])
    own_chars = F.when(F.col("owns").isNull(), 0).when(F.col("depth") >= F.col("owns"), F.col("total") - F.col("before")).otherwise(F.col("total") - F.col("owns_before"))
    has_child = (F.col("depth") < F.col("n")) & (F.coalesce("owns", F.col("n") + 1) <= F.col("depth") + 1)
    summed = met.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(has_child.cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before")) - own_chars).alias("saved_tokens"), *[F.max(q).alias(q) for q in OWN],
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(p).alias(f"above_{p}") for p in SUMS], F.col("conv_id").alias("parent_conv_id"))
    below = summed.withColumns({f"above_{p}": F.col(p) - F.col(q) for p, q in zip(SUMS, OWN, strict=True)})
    out = below.join(above, ["depth", *[f"above_{p}" for p in SUMS]], "left").join(end_digests(ends).withColumnRenamed("n", "depth"), node, "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def conversations_trie(conversations: DataFrame) -> DataFrame:
    turns, convs = rebuilt(numbered_turns(conversations))
    return trie(prefixes(turns), convs)
