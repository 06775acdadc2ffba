"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

The budget is shared by weight among sources, none of which gives more than `epochs` times its own size; what a source
cannot give is shared again by weight. With sources in order of (limit / weight) those at their limit are a prefix of
that order, so one running sum settles all rounds of sharing at once.

A source first gives its whole self as often as it fits into its target. The rest of the target is a weighted sample
without replacement: each document draws u from a hash of its id and text, its key is -ln(u) / quality, and documents are
taken in order of key as long as the running sum of their sizes is within the rest. What is then left goes to the one
document after them whose size is nearest to it, if that brings the source nearer to its target. Keys depend on the rows
alone: reruns agree.

The running sums go over ranges of keys, so that a source of any size is many tasks. Null text: size 0. Null id: the
draw is by text alone. A null source is a source, the last by name. Equal rows have equal keys and follow each other. A
source of size 0 has target 0. Sizes are whole texts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written
from tidegauge.operators.ordering import numbered, running_sums

EPOCHS = 3
#: Quality of documents without a label, and of labelled ones from 0 to 1.
UNKNOWN, WORST, BEST = 1.0, 0.5, 2.0
_BITS = 52


def words(text: str) -> Column:
    """Number of runs of anything but blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(*columns: str) -> Column:
    """A number over 0 and under 1 from the values of a row."""
    text = F.concat_ws(":", *[F.md5(F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")) for c in columns])
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def ranked_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """(source, source_size, weight): the weights in turn, over and over, to sources by code point, null last."""
    ranked = numbered(sizes, [], [F.asc_nulls_last("source")], "place", "n")
    return ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight): all sizes together, shared by weight, with no
    source above `epochs` times its size."""
    capped = sources.withColumn("cap", F.col("source_size") * epochs)
    order = [F.col("cap") / F.col("weight"), F.asc_nulls_last("source")]
    seen = running_sums(capped, [], order, {"cap": "caps", "weight": "weights"})
    whole = seen.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    seen = seen.join(F.broadcast(whole), F.lit(True))  # one row
    exact = lambda c: c.cast("decimal(19,0)")
    left, rest = F.col("total") - F.col("caps") + F.col("cap"), F.col("all_weights") - F.col("weights") + F.col("weight")
    full = written(seen.withColumn("full", exact(F.col("cap")) * exact(rest) < exact(F.col("weight")) * exact(left)), "mixing-targets")
    rate = full.agg((F.max("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("left"), (F.max("all_weights") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0))).alias("rest"))
    share = F.col("weight") * F.col("left").cast("double") / F.col("rest")
    return full.join(F.broadcast(rate), F.lit(True)).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))  # one row


def mix(items: DataFrame, aims: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every item with size, source_size, target, epochs (whole passes over its source), sampled
    (whether it is taken once more) and taken (size by passes). items: (source, size, quality, u, keep); aims: (source,
    source_size, target)."""
    keyed = items.withColumn("key", -F.ln("u") / F.col("quality"))
    placed = running_sums(keyed, ["source"], ["key", "u"], {"size": "through"}, "row")
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    aims = aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    met = placed.join(aims, F.col("source").eqNullSafe(F.col("_source")))
    met = written(met.select(*keep, "source", "size", "source_size", "target", "epochs", "rest", "through", "row"), "mixing-placed")
    inside = F.col("through") <= F.col("rest")
    gaps = met.where("rest > 0").groupBy(F.col("source").alias("_source")).agg((F.max("rest") - F.sum(F.when(inside, F.col("size")).otherwise(0))).alias("gap"))
    after = met.where((F.col("rest") > 0) & ~inside).join(gaps, F.col("source").eqNullSafe(F.col("_source")))
    last = after.groupBy("source").agg(F.max("gap").alias("gap"), F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "row")).alias("last"))
    last = last.where("last.miss < gap").select("last.row", F.lit(True).alias("chosen"))
    sampled = F.coalesce("chosen", (F.col("rest") > 0) & inside)
    out = met.join(last, "row", "left").withColumn("sampled", sampled)
    return out.select(*keep, "size", "source_size", "target", "epochs", "sampled", (F.col("size") * (F.col("epochs") + F.col("sampled").cast("long"))).alias("taken"))


def documents_mix(docs: DataFrame, labels: DataFrame, weights: list[int], epochs: int = EPOCHS) -> DataFrame:
    """`mix` of `documents`, in words, by the mean quality of their labels."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), draw("doc_id", "text").alias("u"))
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("quality").alias("mean"))
    quality = F.when(F.col("mean").isNull(), UNKNOWN).otherwise(WORST + (BEST - WORST) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean"))))
    items = written(slim.join(judged, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "source", "size", "u", quality.alias("quality")), "mixing-items")
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mix(items, targets(ranked_weights(sizes, weights), epochs), ["doc_id"])
