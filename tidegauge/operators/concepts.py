"""Concepts of texts, and the graph of those that stand together in paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import text as tx

#: Where a section ends: a heading, a rule, or two blank lines.
SECTION = r"\n#{1,4}\s|\n-{3,}\n|\n{3,}"


def concept_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, kind, section): each text's concepts, with the kind and the first 80 characters of the section that has
    them first. Texts that are null or have no concept give no row; `key` tells texts apart."""
    sections = F.filter(F.transform(F.split(text, SECTION), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    found = docs.select(key, F.posexplode(sections).alias("_at", "_s")).select(key, "_at", tx.concept_type(F.col("_s")).alias("kind"), F.left("_s", F.lit(80)).alias("section"), F.explode(tx.concepts(F.col("_s"))).alias("name"))
    first = found.groupBy(key, "name").agg(F.min_by(F.struct("kind", "section"), "_at").alias("_f"))
    return first.select(key, "name", "_f.kind", "_f.section")


#: Pairs that are counted, or go out, at once.
MOST_PAIRS = 1 << 17


def _together(parts: list[bytes], names: list[bytes], words: int, least: float) -> tuple[int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of one text: how many of its parts are not blank, each name's share of the words, and pairs i < j of names with the
    number of parts that hold both, in runs of a bounded size; without pairs that are clearly below `least`."""
    whole = b"\n".join(parts)  # no name has a line break, so none is found across parts
    starts = np.cumsum([0] + [len(s) + 1 for s in parts])
    full = np.array([bool(s.strip()) for s in parts])
    at, times = [], np.zeros(len(names), np.int64)
    for k, name in enumerate(names):
        term, before = name.replace(b"_", b" "), len(at)
        place = whole.find(term)
        while place >= 0:
            at.append(place)
            place = whole.find(term, place + len(term))
        times[k] = len(at) - before
    n, p = max(int(full.sum()), 1), times / words
    line = np.searchsorted(starts, np.array(at, np.int64), "right") - 1
    held = np.unique(np.repeat(np.arange(len(names)), times)[full[line]] * len(parts) + line[full[line]])
    name, line = np.divmod(held, len(parts))
    share = np.bincount(name, minlength=len(names)) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        hopeful = share * np.log2(share / (p / words + 1e-12)) > least - 1e-9
    name, line = name[hopeful[name]], line[hopeful[name]]
    return n, p, _pairs(name, line, len(parts), n, p, least)


def _pairs(name: np.ndarray, line: np.ndarray, lines: int, n: int, p: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    by_line = np.argsort(line, kind="stable")
    mates, count = name[by_line], np.bincount(line, minlength=lines)
    first = np.cumsum(count) - count
    todo = np.cumsum(count[line])
    begin = 0
    while begin < len(name):
        # whole names, so that each pair is counted to the end
        end = int(np.searchsorted(todo, (todo[begin - 1] if begin else 0) + MOST_PAIRS, "right"))
        end = int(np.searchsorted(name, name[end], "left")) if end < len(name) else end
        end = end if end > begin else int(np.searchsorted(name, name[begin], "right"))
        size = count[line[begin:end]]
        other = mates[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[line[begin:end]], size)]
        one = np.repeat(name[begin:end], size)
        code, both = np.unique((one * len(p) + other)[one < other], return_counts=True)
        i, j = np.divmod(code, len(p))
        near = both / n * np.log2(both / n / (p[i] * p[j] + 1e-12)) > least - 1e-9
        if near.any():
            yield i[near], j[near], both[near]
        begin = end


def _rows(keys: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    size = [len(f[4]) for f in found]
    texts = np.repeat([f[0] for f in found], size)
    names = pa.array([name for f in found for name in f[1]], pa.binary())
    base = np.repeat(np.cumsum([0] + [len(f[1]) for f in found])[:-1], size)
    i, j, both, p = (np.concatenate([f[k] for f in found]) for k in (4, 5, 6, 3))
    i, j = i + base, j + base
    return pa.record_batch({"_key": keys.take(pa.array(texts)), "_n": pa.array(np.repeat([f[2] for f in found], size), pa.int32()), "_a": names.take(pa.array(i)), "_p": pa.array(p[i]), "_b": names.take(pa.array(j)), "_q": pa.array(p[j]), "_both": pa.array(both)})


def concept_graph(docs: DataFrame, key: str, text: str, least: float = 0.005, paragraph: str = "\n\n") -> DataFrame:
    """(key, a, b, weight), in both directions: p12 log2(p12 / (p1 p2)) of two concepts of a text where that is over `least`;
    p1 and p2 are how often they are in it for each of its words, p12 is the share of paragraphs that hold both.

    A paragraph is a part of the text between `paragraph`, a pattern of line breaks, that is not blank. Concepts go to the paragraphs that hold them, and pairs
    are formed there only. Before that, a concept is left out if no partner could lift it over `least`: p12 is at most its
    own share of paragraphs, and no partner is rarer than one in all words. A text's pairs are counted where the text is, so
    that none are shuffled or kept; a task holds a batch of texts and the next rows of its result. `key` tells texts apart;
    null texts give no row."""
    t, kind = F.col(text), docs.schema[key].dataType.simpleString()
    names = F.array_distinct(F.flatten(F.transform(F.split(t, SECTION), tx.concepts)))
    words = F.greatest(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")), F.lit(1))
    read = docs.where(t.isNotNull()).select(F.col(key).alias("_key"), F.split(F.lower(t), paragraph).cast("array<binary>").alias("_parts"), names.cast("array<binary>").alias("_names"), words.alias("_words"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            for r in range(b.num_rows):
                told = b["_names"][r].as_py()
                n, p, pairs = _together(b["_parts"][r].as_py(), told, b["_words"][r].as_py(), least)
                for i, j, both in pairs:
                    found.append((r, told, n, p, i, j, both))
                    held += len(i)
                    if held >= MOST_PAIRS:
                        yield _rows(b["_key"], found)
                        found, held = [], 0
            if found:
                yield _rows(b["_key"], found)

    both = read.mapInArrow(linked, f"_key {kind}, _n int, _a binary, _p double, _b binary, _q double, _both long")
    both = both.select(F.col("_key").alias(key), "_n", F.col("_a").cast("string").alias("_a"), "_p", F.col("_b").cast("string").alias("_b"), "_q", "_both")
    joint = F.col("_both") / F.col("_n")
    weighed = both.withColumn("weight", joint * F.log2(joint / (F.col("_p") * F.col("_q") + 1e-12))).where(F.col("weight") > least)
    ways = F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(F.col("_b").alias("a"), F.col("_a").alias("b")))
    return weighed.select(key, F.explode(ways).alias("_w"), "weight").select(key, "_w.a", "_w.b", "weight")
