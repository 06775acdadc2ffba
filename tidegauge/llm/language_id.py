"""Language identification by bit-sliced Bloom filters of character n-grams.

Training: the distinct n-grams of a bounded sample of labelled texts are counted by language (texts that have them),
and an n-gram belongs to each language in which it is about as usual as in the language where it is most usual. The
filter is a table of `2**BITS` bit masks or more, a bit for each language in planes of 64; an n-gram sets its languages' bits at `PROBES`
places, so that ANDing the masks found there gives all languages containing it at once. Prediction: languages' bits
are counted over a text's n-grams, corrected for each language's share of false positives, and the largest count wins.

Texts that are null or have no letter are `und` with score 0; other texts always get a learned language. Equal counts:
the language first in order. Labels that are null are not learned from. Repeated rows count as often as they are
there. With no labelled row at all every text is `und`. Columns of the input beside those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, texts_in_pieces

#: Most labelled texts of a language learned from (in expectation, by a hash of the id), and languages in a plane of masks.
MOST_TEXTS, PLANE = 3_000, 64
#: Letters in an n-gram, least size of the filter (2**BITS masks), and places an n-gram takes.
GRAM, BITS, PROBES = 4, 22, 3
#: An n-gram belongs to a language if this share of the usage of the language using it most is reached.
RATIO, LEAST_TEXTS = 0.5, 3

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def grams(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the n-grams of letters; every word has a space before and after it."""
    owners = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    joined = " " + "  ".join(texts) + " " if texts else ""
    c = _fold()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32) | (owners[1:] != owners[:-1])] if len(c) else np.zeros(0, bool)
    c, owners = c[keep].astype(np.uint64), owners[keep]
    n = len(c) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(gram):
        h = h * np.uint64(0x110001) + c[k : k + n]
        if 0 < k < gram - 1:
            inner |= c[k : k + n] == 32
    ok = ~inner & (owners[:n] == owners[gram - 1 :]) & ~((c[:n] == 32) & (c[1 : n + 1] == 32))
    h = h[ok]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h, owners[:n][ok]


def places(h: np.ndarray, bits: int = BITS, probes: int = PROBES) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(probes)]


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # a row of 2**bits for each 64 languages, of the smallest unsigned type that holds a bit for each
    false: np.ndarray  # each language's share of absent n-grams that seem present

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected number of them in each language)."""
        h, owner = grams(texts)
        kind = self.masks.dtype.type
        found = np.full((len(self.masks), len(h)), np.iinfo(kind).max, kind)
        for at in places(h, self.masks.shape[1].bit_length() - 1):
            found &= self.masks[:, at]
        total = np.bincount(owner, minlength=len(texts))
        hits = np.stack([np.bincount(owner, (found[k // PLANE] >> kind(k % PLANE)) & kind(1), minlength=len(texts)) for k in range(len(self.languages))], 1)
        return total, np.maximum(0.0, (hits - total[:, None] * self.false) / (1 - self.false))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, counts = self.counts(texts)
        letters = [any(map(str.isalpha, t)) for t in texts]  # n-grams are also made of marks
        best = counts.argmax(1)
        score = counts[np.arange(len(texts)), best] / np.maximum(counts.sum(1), 1e-9)
        return [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def train(docs: DataFrame, trainable: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_texts: int = MOST_TEXTS) -> Filter | None:
    """Learns from the rows for whose id `trainable` holds and the language is known. Only counts by language and the
    n-grams kept for the filter reach the driver; the latter are at most some hundred thousand, as the sample is
    bounded."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), trainable(F.col(id_col)).alias("t")).where("t and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, most_texts / sizes[k]))]), F.col("lang"))
    sample = labelled.where((F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 20)) < share * (1 << 20))).select("text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        used: dict[tuple[int, int], int] = {}
        texts_of = np.zeros(len(languages), np.int64)
        for b in batches:
            of = np.array([number[x.as_py()] for x in b.column(1)])
            for first, texts in texts_in_pieces(b, "text"):
                h, owner = grams(texts)
                lang = of[first : first + len(texts)]
                texts_of += np.bincount(lang, minlength=len(languages))
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
                h, l = h[once], lang[owner[once]].astype(np.uint64)
                for k in np.unique(l):
                    for gram, n in zip(*np.unique(h[l == k], return_counts=True), strict=True):
                        key = (int(gram), int(k))
                        used[key] = used.get(key, 0) + int(n)
        keys = np.array([k[0] for k in used], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([k[1] for k in used], pa.int32()), pa.array(list(used.values()), pa.int64())], ["gram", "lang", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(languages), pa.int64()), pa.array(range(len(languages)), pa.int32()), pa.array(texts_of)], ["gram", "lang", "n"])

    counted = map_batches(sample, count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    seen = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    texts = F.element_at(F.array(*[F.lit(float(max(1, seen.get(k, 0)))) for k in languages]), F.col("lang") + 1)
    usual = counted.where(F.col("gram").isNotNull() & (F.col("n") >= LEAST_TEXTS)).withColumn("p", F.col("n") / texts)
    most = usual.groupBy("gram").agg(F.collect_list(F.struct("lang", "p")).alias("by"), F.max("p").alias("top"))
    kept = most.select("gram", F.transform(F.filter("by", lambda x: x.p >= F.col("top") * RATIO), lambda x: x.lang).alias("langs"))
    table = kept.toArrow()
    h = table.column("gram").to_numpy().view(np.uint64)
    bits, planes, shares = max(BITS, (4 * PROBES * len(h)).bit_length()), -(-len(languages) // PLANE), []
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), PLANE) <= np.iinfo(t).bits)
    masks, langs = np.zeros((planes, 1 << bits), kind), table.column("langs").to_pylist()
    for plane in range(planes):
        mask = np.array([sum(1 << (k % PLANE) for k in x if k // PLANE == plane) for x in langs], kind)
        for at in places(h, bits):
            np.bitwise_or.at(masks[plane], at, mask)
    for k in range(len(languages)):
        shares.append(float(((masks[k // PLANE] >> kind(k % PLANE)) & kind(1)).mean()) ** PROBES)
    return Filter(languages, masks, np.minimum(np.array(shares), 0.99))


def predict(docs: DataFrame, model: Filter | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row with lang_pred and score; the filter is 4 MB for
    up to 8 languages, 32 MB for each 64, and more from some 350,000 n-grams on."""
    keep = keep or ["doc_id"]
    chosen = docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    row = chosen.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for _, texts in texts_in_pieces(b, "text"):
                if m is None:
                    langs += ["und"] * len(texts)
                    scores.append(np.zeros(len(texts)))
                else:
                    l, s = m.predict(texts)
                    langs += l
                    scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["row", "lang_pred", "score"])

    return map_batches(chosen, run, f"row {row}, lang_pred string, score double").select("row.*", "lang_pred", "score")
