"""Join operators: keyword and tier lookups, pair joins, upserts, edges of a market graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import market
from tidegauge.operators.blocks import MOST_ROWS, TILE, apart, batch, block_pairs, blocks_across, dots, matrix, rounded, tiles, widened
from tidegauge.operators.nearest import beside, nearest_in_space
from tidegauge.operators.store import written


def categorize(df: DataFrame, key: list[str], column: str, topics: list[tuple[str, str]], k: int) -> DataFrame:
    """Each row's first topic of which a word is in it, else `misc`; the first k rows of a topic. topics: (topic, word)."""
    out = F.lit("misc")
    for topic, word in reversed(topics):
        out = F.when(F.contains(F.col(column), F.lit(word)), topic).otherwise(out)
    w = Window.partitionBy(*key, "topic").orderBy(column)
    return df.withColumn("topic", out).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def classify_domain(docs: DataFrame, keywords: DataFrame, key: str, text: str, k: int = 1) -> DataFrame:
    """(key, domain, score) of the k domains that share most words with a text; `unknown` without any. keywords: (ord,
    domain, word)."""
    if keywords.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        keywords = F.broadcast(keywords)  # so that only words that hit are shuffled
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("word"))
    hits = words.join(keywords, "word").groupBy(key, "ord", "domain").agg(F.count("*").alias("score"))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))).where(F.col("_r") <= k)
    return docs.select(key).join(best.select(key, "domain", "score"), key, "left").select(key, F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("score", F.lit(0)).alias("score"))


def concept_weights(pairs: DataFrame, text: str, c1: str, c2: str, paragraph: str = "\n\n") -> DataFrame:
    """Adds `mi`: p12 log2(p12 / (p1 p2)) of two terms, from how often they are in a text and together in paragraphs."""
    low = F.lower(text)
    n = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1
    share = lambda c: (F.length(low) - F.length(F.replace(low, F.col(c), F.lit("")))) / F.length(c) / n
    parts = F.split(low, paragraph)
    together = F.size(F.filter(parts, lambda p: F.contains(p, F.col(c1)) & F.contains(p, F.col(c2)))) / F.size(parts)
    rows = pairs.withColumn("_p1", share(c1)).withColumn("_p2", share(c2)).withColumn("_p12", together)
    mi = F.when((F.col("_p12") > 0) & (F.col("_p1") > 0) & (F.col("_p2") > 0), F.col("_p12") * F.log2(F.col("_p12") / (F.col("_p1") * F.col("_p2") + 1e-12))).otherwise(0.0)
    return rows.withColumn("mi", mi).drop("_p1", "_p2", "_p12")


def find_universals(patterns: DataFrame, least: float = 0.85, dense: bool | None = None) -> DataFrame:
    """(a, b, similarity) of patterns of different dimensions with a cosine of at least `least` over their active places.
    patterns: (pattern_id, dimension, dims). Sets meet under their places (an inverted index); a set only lists as many
    of its rarest places as it must share with any similar one (prefix filtering), so that common places join nothing.
    Where so few places are so common that the index would give more than a small share of all pairs (counted first, or
    told by `dense`), sets are compared block by block instead, without a table of candidates."""
    sizes = patterns.select("pattern_id", "dimension", F.array_distinct("dims").alias("dims")).where("size(dims) > 0")
    flat = sizes.select("pattern_id", F.explode("dims").alias("dim"))
    rarity = flat.groupBy("dim").agg(F.count("*").alias("df"))
    ranked = flat.join(rarity, "dim").groupBy("pattern_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "dim"))), lambda x: x["dim"]).alias("ordered"))
    prefix = F.size("ordered") - F.ceil(F.size("ordered") * least * least).cast("int") + 1
    listed = ranked.select("pattern_id", F.explode(F.slice("ordered", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("dim")).join(sizes.select("pattern_id", "dimension"), "pattern_id")
    if dense is None:
        listed = written(listed, "listed-places")
        met = listed.groupBy("dim").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s")).first()["s"]
        dense = (met or 0.0) * DENSE > float(sizes.count()) ** 2
    if dense:
        return _universals_in_blocks(sizes, least)
    left, right = listed.select(F.col("pattern_id").alias("a"), F.col("dimension").alias("da"), "dim"), listed.select(F.col("pattern_id").alias("b"), F.col("dimension").alias("db"), "dim")
    pairs = left.join(right, "dim").where("da < db").select("a", "b").distinct()
    full = pairs.join(sizes.select(F.col("pattern_id").alias("a"), F.col("dims").alias("x")), "a").join(sizes.select(F.col("pattern_id").alias("b"), F.col("dims").alias("y")), "b")
    similarity = F.size(F.array_intersect("x", "y")) / F.sqrt(F.size("x").cast("double") * F.size("y"))
    return full.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


#: How many compared pairs cost as much as one candidate of an index, which is joined, shuffled and told apart.
DENSE = 32


def _universals_in_blocks(sizes: DataFrame, least: float) -> DataFrame:
    """All pairs of sets by products of 0/1 matrices over the places that a pair of blocks has."""
    kind = sizes.schema["pattern_id"].dataType.simpleString()

    def alike(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        types = {"a": left.schema.field("pattern_id").type, "b": left.schema.field("pattern_id").type}
        lists = [t["dims"].combine_chunks() for t in (left, right)]
        counts = [np.asarray(pa.compute.list_value_length(x), dtype=np.int64) for x in lists]
        places = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode(null_encoding="encode")
        index, n_places, ends = np.asarray(places.indices), len(places.dictionary), counts[0].sum()
        column = [index[:ends], index[ends:]]
        row = [np.repeat(np.arange(len(c)), c) for c in counts]
        ids, dims = [t["pattern_id"].to_numpy() for t in (left, right)], [t["dimension"].to_numpy() for t in (left, right)]
        for at in range(0, len(ids[0]), 512):
            n = min(512, len(ids[0]) - at)
            mine = (row[0] >= at) & (row[0] < at + n)
            shared = np.zeros((n, len(ids[1])), dtype=np.float32)  # whole numbers under 2^24
            for first in range(0, n_places, 1024):
                x, y = np.zeros((n, 1024), dtype=np.float32), np.zeros((len(ids[1]), 1024), dtype=np.float32)
                for z, r, c in ((x, row[0][mine] - at, column[0][mine]), (y, row[1], column[1])):
                    here = (c >= first) & (c < first + 1024)
                    z[r[here], c[here] - first] = 1.0
                used = min(1024, n_places - first)
                shared += x[:, :used] @ y[:, :used].T
            near = shared.astype(np.float64) >= (least - 1e-9) * np.sqrt(counts[0][at : at + n, None].astype(np.float64) * counts[1][None, :])
            r, c = np.nonzero(near)
            similarity = shared[r, c].astype(np.float64) / np.sqrt(counts[0][at + r].astype(np.float64) * counts[1][c])
            one, two, p, q = dims[0][at + r], dims[1][c], ids[0][at + r], ids[1][c]
            below, above = (one < two).astype(bool), np.zeros(len(r), dtype=bool) if same else (one > two).astype(bool)
            keep = (below | above) & (similarity >= least)
            if keep.any():
                yield batch(types, a=np.where(below, p, q)[keep], b=np.where(below, q, p)[keep], similarity=similarity[keep])

    known = sizes.where("pattern_id is not null and dimension is not null")
    return block_pairs(known, "pattern_id", alike, f"a {kind}, b {kind}, similarity double", most=8192)


def new_only(found: DataFrame, known: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Pairs without a known one of the same dimensions, near similarity and a shared type. Columns: dimensions (sorted
    array), similarity, types (array)."""
    band = lambda c: F.floor(F.col(c) / tolerance)
    k = known.select(F.col("dimensions").alias("_d"), F.col("similarity").alias("_s"), F.col("types").alias("_t"), F.explode(F.array(*[band("similarity") + d for d in (-1, 0, 1)])).alias("_b"))
    near = (F.col("dimensions") == F.col("_d")) & (band("similarity") == F.col("_b"))  # bands make it an equi-join
    return found.join(k, near & (F.abs(F.col("similarity") - F.col("_s")) <= tolerance) & F.arrays_overlap("types", "_t"), "left_anti")


def wasserstein(a: Column, b: Column) -> Column:
    """Mean distance of two sorted spectra, the shorter one padded with zeros."""
    return F.aggregate(F.zip_with(F.sort_array(a), F.sort_array(b), lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.size(b))


def spectrum_pairs(df: DataFrame, key: str, spectrum: str, bucket: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b; within buckets where one is given; rounded to `digits` where these are. Spectra
    are sorted once, and meet block by block, in which numpy adds up their distances tile by tile; the result has the square
    of a bucket as rows."""
    kind = df.schema[key].dataType.simpleString()
    sorted_ = F.transform(F.sort_array(F.col(spectrum)), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), sorted_.alias("x"), *([F.col(bucket).alias("_bucket")] if bucket else []))
    rows = rows.where(F.col("_bucket").isNotNull()) if bucket else rows

    def pairs(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        types = {"a": left.schema.field("k").type, "b": left.schema.field("k").type, "distance": pa.float64()}
        (x, n), (y, m) = matrix(left["x"]), matrix(right["x"])
        xt, yt = (np.ascontiguousarray(widened(z, max(x.shape[1], y.shape[1])).T) for z in (x, y))
        i, j = left["k"].to_numpy(), right["k"].to_numpy()
        alike = len(n) and len(m) and n.min() == n.max() == m.min() == m.max() > 0
        pad = np.empty((2, TILE))
        for some, first in tiles(len(i), len(j), same):
            one, two = np.broadcast_arrays(i[some, None], j[None, first:])
            less = (one < two).astype(bool)
            keep = less | (one > two).astype(bool)
            if same:
                keep &= np.arange(first, len(j))[None, :] > np.arange(some.start, some.stop)[:, None]
            size = n[0] if alike else np.maximum(n[some, None], m[None, first:])
            total = apart(xt[:, some], yt[:, first:], pad) / (size if alike else np.maximum(size, 1))
            a, b, distance, whole = np.where(less, one, two).ravel(), np.where(less, two, one).ravel(), total.ravel(), keep.all()
            if not whole:
                a, b, distance = (z[keep.ravel()] for z in (a, b, distance))
            distance = distance if digits is None else rounded(distance, digits)
            if not alike:
                unknown = (n[some, None] < 0) | (m[None, first:] < 0) | (size == 0)
                distance = np.ma.masked_array(distance, unknown[keep])
            if len(a):
                yield batch(types, a=a, b=b, distance=distance)

    return block_pairs(rows, "k", pairs, f"a {kind}, b {kind}, distance double", ["_bucket"] if bucket else None, most=8192, least=8)


def inject_sentiment(tickers: DataFrame, scores: DataFrame) -> DataFrame:
    """Known tickers with their sentiment smoothed by each article in turn: 0.7 old + 0.3 new, within -1 and 1. tickers:
    (symbol, sentiment); scores: (symbol, ord, score). Whatever came 200 articles before weighs under 1e-30, so a symbol's
    last 200 are folded, however many it has."""
    last = scores.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ord")))).where("_r <= 200")
    folded = last.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ord", "score"))).alias("_s"))
    value = F.aggregate(F.coalesce("_s", F.array()), F.col("sentiment").cast("double"), lambda acc, s: market.clip(0.7 * acc + 0.3 * s["score"], -1.0, 1.0))
    return tickers.join(folded, "symbol", "left").withColumn("sentiment", value).drop("_s")


def best_match(requests: DataFrame, catalog: DataFrame, key: str, energy: str = "energy") -> DataFrame:
    """Each request's catalog entry: of its domain and operation, else of its domain; the lowest energy, then the name."""
    entries = catalog.select(F.col("domain"), F.col("operation").alias("_op"), "name", F.col(energy))
    both = requests.join(entries, "domain").withColumn("tier", F.when(F.col("operation") == F.col("_op"), 0).otherwise(1))
    best = both.groupBy(key).agg(F.min(F.struct("tier", energy, "name")).alias("m"))
    return best.select(key, "m.*")


def recognize(queries: DataFrame, atlas: DataFrame, tau: float, largest: int = 8) -> DataFrame:
    """(q, name, distance, confidence, ratio): each query's nearest atlas entry by frequency, of its own domain if that has
    any, rejected at tau or farther, and the small ratio nearest to that of the two frequencies (0:1 for a zero one).
    Equally near ones go by name. queries: (q, domain, w); atlas: (name, domain, w)."""
    from tidegauge.functions.spectral import ratio_label

    asked = queries.select("q", "domain", F.col("w").cast("double").alias("w"))
    listed = atlas.where("w is not null").select("name", "domain", F.col("w").cast("double").alias("w"))
    entry = F.struct(F.col("w"), F.col("name")).alias("entry")
    own = beside(asked, listed.where("domain is not null").groupBy("domain", "w").agg(F.min("name").alias("name")).select("domain", "w", entry), ["domain"], "w")
    alone = F.col("before").isNull() & F.col("after").isNull()
    others = beside(own.where(alone).select("q", "domain", "w"), listed.groupBy("w").agg(F.min("name").alias("name")).select("w", entry), [], "w")
    sides = F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("w") - F.col(f"{s}.w")).alias("far"), F.col(f"{s}.name").alias("name"), F.col(f"{s}.w").alias("at"))) for s in ("before", "after")])
    best = own.where(~alone).unionByName(others).withColumn("m", F.array_min(F.array_compact(sides))).where(F.col("m.far") < tau)
    ratio = F.when(F.abs("m.at") < 1e-12, "0:1").otherwise(ratio_label(F.col("w") / F.col("m.at"), largest))
    return best.select("q", "m.name", F.col("m.far").alias("distance"), (1 - F.col("m.far") / tau).alias("confidence"), ratio.alias("ratio"))


def coherence(a: DataFrame, b: DataFrame, key: str, sigma: float, most_pairs: int = 15) -> DataFrame:
    """Each key's mean lock of mode pairs, exp(-tau / sigma), over the first pairs in order, and the strongest pair.
    Columns: key, idx, frequency, stability, variance; unstable or noisy modes do not count."""
    from tidegauge.functions.spectral import dissonance

    fit = lambda d, s: d.where("stability >= 0.6 and variance < 1.0").select(key, F.col("idx").alias(f"i{s}"), F.col("frequency").alias(f"f{s}"))
    pairs = fit(a, "a").join(fit(b, "b"), key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ia", "ib"))).where(F.col("_r") <= most_pairs)
    pairs = pairs.withColumn("lock", F.exp(-dissonance(F.col("fa"), F.col("fb")) / sigma))
    return pairs.groupBy(key).agg(F.avg("lock").alias("coherence"), F.max("lock").alias("strongest"), F.max_by(F.struct("ia", "ib"), F.struct("lock", -F.col("ia"), -F.col("ib"))).alias("dominant"))


def mode_locks(a: DataFrame, b: DataFrame, key: str, sigma: float, most_pairs: int = 15, largest: int = 8) -> DataFrame:
    """(key, ia, ib, tau, lock, p, q, off): each key's first mode pairs in order, how far their frequencies are from a small
    ratio, the lock exp(-tau / sigma), and the ratio's best fraction with its distance. Modes as for `coherence`, of which
    no more than the first `most_pairs` on a side can be in a pair."""
    from tidegauge.functions.spectral import best_rational, dissonance

    def fit(d: DataFrame, s: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
        return d.where("stability >= 0.6 and variance < 1.0").withColumn("_r", first).where(F.col("_r") <= most_pairs).select(key, F.col("idx").alias(f"i{s}"), F.col("frequency").alias(f"f{s}"))

    pairs = fit(a, "a").join(fit(b, "b"), key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ia", "ib"))).where(F.col("_r") <= most_pairs)
    ratio = F.col("fa") / F.greatest("fb", F.lit(1e-15))
    told = pairs.withColumn("tau", dissonance(F.col("fa"), F.col("fb"))).withColumn("_x", ratio).withColumn("_b", best_rational(F.col("_x"), largest))
    return told.select(key, "ia", "ib", "tau", F.exp(-F.col("tau") / max(sigma, 1e-15)).alias("lock"), F.col("_b.p").alias("p"), F.col("_b.q").alias("q"), F.abs(F.col("_x") - F.col("_b.p") / F.col("_b.q")).alias("off"))


def coherence_state(locks: DataFrame, entropies: DataFrame, key: str) -> DataFrame:
    """(key, coherence, dominant, entropy_drop): the mean lock, the strongest pair (the first of equal ones; null without a
    pair), and by how much the second spectrum's entropy is lower. entropies: (key, first, second), one row a key."""
    pair = F.struct("ia", "ib", "lock", "p", "q", "off")
    best = locks.groupBy(key).agg(F.avg("lock").alias("_c"), F.max_by(pair, F.struct(F.col("lock"), -F.col("ia"), -F.col("ib"))).alias("dominant"))
    return entropies.join(best, key, "left").select(key, F.coalesce("_c", F.lit(0.0)).alias("coherence"), "dominant", (F.col("first") - F.col("second")).alias("entropy_drop"))


def market_laplacian(tickers: DataFrame, correlations: DataFrame) -> DataFrame:
    """(i, j, g): weighted Laplacian of correlation edges (|corr| 10 on the diagonal, minus corr 10 beside it) plus 100
    times volatility on the diagonal."""
    e = correlations.select("a", "b", "corr")
    off = e.select(F.col("a").alias("i"), F.col("b").alias("j"), (-10.0 * F.col("corr")).alias("g")).union(e.select("b", "a", -10.0 * F.col("corr")))
    on = e.select(F.col("a").alias("i"), F.col("a").alias("j"), (10.0 * F.abs("corr")).alias("g")).union(e.select("b", "b", 10.0 * F.abs("corr")))
    own = tickers.select(F.col("symbol").alias("i"), F.col("symbol").alias("j"), (100.0 * F.col("volatility")).alias("g"))
    return off.union(on).union(own).groupBy("i", "j").agg(F.sum("g").alias("g"))


def same_sector_pairs(tickers: DataFrame) -> DataFrame:
    return tickers.select(F.col("symbol").alias("a"), "sector").join(tickers.select(F.col("symbol").alias("b"), "sector"), "sector").where("a < b")


def shared_characters(a: DataFrame, b: DataFrame, key: str, tolerance: float, top_k: int) -> DataFrame:
    """One-to-one matches of characters (key, id, frequency, decay, vector) by nearness of frequency and decay and a cosine
    over 0.5, the nearest first. Candidates meet in frequency bands; only a key's own candidates are matched greedily."""
    import pandas as pd

    band = lambda d, s: d.select(key, F.col("id").alias(f"id_{s}"), F.col("frequency").alias(f"f_{s}"), F.col("decay").alias(f"d_{s}"), F.col("vector").alias(f"v_{s}"), F.floor(F.col("frequency") / tolerance).alias(f"k_{s}"))
    left = band(a, "a").withColumn("k", F.explode(F.array(F.col("k_a") - 1, F.col("k_a"), F.col("k_a") + 1)))
    near = left.join(band(b, "b").withColumnRenamed("k_b", "k"), [key, "k"]).where((F.abs(F.col("f_a") - F.col("f_b")) <= tolerance) & (F.abs(F.col("d_a") - F.col("d_b")) <= 10 * tolerance))
    near = near.withColumn("cos", market.cosine(F.col("v_a"), F.col("v_b"))).where("abs(cos) > 0.5").select(key, "id_a", "id_b", F.abs(F.col("f_a") - F.col("f_b")).alias("far"), "cos")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, rows = set(), set(), []
        for r in pdf.sort_values(["far", "id_a", "id_b"]).itertuples(index=False):
            if r.id_a not in used_a and r.id_b not in used_b and len(rows) < top_k:
                used_a.add(r.id_a)
                used_b.add(r.id_b)
                rows.append(r)
        return pd.DataFrame(rows, columns=pdf.columns)

    return near.groupBy(key).applyInPandas(greedy, near.schema)


def code_edges(modules: DataFrame) -> DataFrame:
    """(src, dst, etype, weight) of import, call and inheritance edges. modules: (module, imports, calls, bases, defines,
    complexity)."""
    short = modules.select(F.element_at(F.split("module", r"\."), -1).alias("name"), F.col("module").alias("dst"))
    defined = modules.select(F.explode("defines").alias("name"), F.col("module").alias("dst"))
    use = lambda c, *more: modules.select(F.col("module").alias("src"), F.explode(c).alias("name"), *more)
    imports = use(F.transform("imports", lambda x: F.element_at(F.split(x, r"\."), -1))).join(short, "name").select("src", "dst", F.lit("import").alias("etype"), F.lit(1.0).alias("weight"))
    calls = use("calls", "complexity").join(defined, "name").select("src", "dst", F.lit("call").alias("etype"), F.greatest(F.lit(1.0), F.col("complexity") / 10).alias("weight"))
    bases = use("bases").join(defined, "name").select("src", "dst", F.lit("inherit").alias("etype"), F.lit(1.0).alias("weight"))
    return imports.unionByName(calls).unionByName(bases).where("src != dst").groupBy("src", "dst", "etype").agg(F.max("weight").alias("weight"))


def merge_experience(memory: DataFrame, new: DataFrame, key_near: float = 0.15, spectrum_near: float = 0.25) -> DataFrame:
    """Upserts rows (id, k1, k2, k3, spec, improvement, n_obs): a new row near an old one in key and spectrum raises its
    count and keeps the better improvement; others are added. Blocks of new rows meet blocks of old ones; matrix products
    pick each new row's candidates, whose distances are then summed in order, and its nearest of a block goes on."""
    whole = F.array(*[F.col(k).cast("double") for k in ("k1", "k2", "k3")])
    spec = F.col("spec").cast("array<double>")
    left = new.select(F.col("id").alias("new_id"), "improvement", whole.alias("x"), spec.alias("s"))
    right = memory.where("id is not null").select("id", whole.alias("y"), spec.alias("t"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, "new_id"), (left, "improvement"), (right, "id"))]

    def near(new: pa.Table, old: pa.Table) -> Iterator[pa.RecordBatch]:
        (x, _), (y, _), (s, ls), (t, lt) = (matrix(c) for c in (new["x"], old["y"], new["s"], old["t"]))
        s, t = (widened(z, max(s.shape[1], t.shape[1])) for z in (s, t))
        ids = np.unique(old["id"].to_numpy(), return_inverse=True)[1]
        yt, tt, yy, ttt = np.ascontiguousarray(y.T), np.ascontiguousarray(t.T), (y * y).sum(1), (t * t).sum(1)
        for at in range(0, len(x), 128):
            a, b = x[at : at + 128], s[at : at + 128]
            aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[:, None]
            far, apart = aa + yy - 2 * (a @ yt), bb + ttt - 2 * (b @ tt)
            room, more = 1e-12 * (1 + aa + yy), 1e-12 * (1 + bb + ttt)  # for rounding
            alike = (ls[at : at + 128, None] == lt) & (lt >= 0)
            maybe = alike & (far <= key_near**2 + room) & (apart < spectrum_near**2 + more)
            sure = maybe & (far <= key_near**2 - room) & (apart < spectrum_near**2 - more)
            bound = np.where(sure, far + 2 * room, np.inf).min(axis=1, initial=np.inf)
            r, c = np.nonzero(maybe & (far - 2 * room <= bound[:, None]))
            off, wide = x[at + r] - y[c], s[at + r] - t[c]
            off, wide = np.sqrt(dots(off.T, off.T)), np.sqrt(dots(wide.T, wide.T))
            hit = (off <= key_near) & (wide < spectrum_near)
            r, c, off = r[hit], c[hit], off[hit]
            order = np.lexsort((ids[c], off, r))
            r, c, off = r[order], c[order], off[order]
            first = np.diff(r, prepend=-1) > 0
            if first.any():
                rows, mates = pa.array(at + r[first]), pa.array(c[first])
                yield batch({}, new_id=new["new_id"].take(rows).combine_chunks(), improvement=new["improvement"].take(rows).combine_chunks(), id=old["id"].take(mates).combine_chunks(), far=off[first])

    hits = blocks_across(left, "new_id", right, "id", near, f"new_id {kinds[0]}, improvement {kinds[1]}, id {kinds[2]}, far double")
    best = hits.groupBy("new_id").agg(F.min_by(F.struct("id"), F.struct("far", "id")).alias("o"), F.max("improvement").alias("improvement"))
    gain = best.groupBy(F.col("o.id").alias("id")).agg(F.count("*").alias("_more"), F.max("improvement").alias("_best"))
    kept = memory.join(gain, "id", "left").withColumn("n_obs", F.col("n_obs") + F.coalesce("_more", F.lit(0))).withColumn("improvement", F.greatest("improvement", F.coalesce("_best", "improvement"))).drop("_more", "_best")
    return kept.unionByName(new.join(best.select(F.col("new_id").alias("id")), "id", "left_anti"))


def nearest_keys(queries: DataFrame, memory: DataFrame, n: int, over: int = 1) -> DataFrame:
    """(q, distance, rank, memory's columns) of the n * over nearest memories by a three-part key; equally near ones by id.
    queries: (q, k1, k2, k3)."""
    return nearest_in_space(queries, memory, n * over, ["k1", "k2", "k3"])


def cosine_top_k(queries: DataFrame, store: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(q, id, similarity, rank) of the k stored vectors nearest to each query by cosine. queries: (q, v). Blocks of queries
    meet blocks of stored vectors; a matrix product picks each block's candidates, whose cosines are then summed in order,
    and the k best of a block go on."""
    whole = lambda v: F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    s = store.select("id", market.normalized(whole(F.col("v"))).alias("u")).where(F.size("u") > 0)
    asked = queries.select("q", market.normalized(whole(F.col("v"))).alias("w"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "q"), (s, "id"))]

    def near(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        types = {"q": left.schema.field("q").type, "id": right.schema.field("id").type, "similarity": pa.float64()}
        (w, n), (u, _) = matrix(left["w"]), matrix(right["u"])
        w, u = (widened(z, max(w.shape[1], u.shape[1])) for z in (w, u))
        q, ids = left["q"].to_numpy(), right["id"].to_numpy()
        ut, top = np.ascontiguousarray(u.T), min(k, len(ids))
        for at in range(0, len(q), 128):
            about = w[at : at + 128] @ ut
            about[np.isnan(about)] = np.inf  # not a number is the largest, as for Spark
            bound = np.partition(about, about.shape[1] - top, axis=1)[:, about.shape[1] - top]
            r, c = np.nonzero(about >= np.where(np.isfinite(bound), bound - 1e-9 * (1 + np.abs(bound)), bound)[:, None])
            similarity = dots(w[at + r].T, u[c].T)
            order = np.lexsort((ids[c], -np.where(np.isnan(similarity), np.inf, similarity), r))
            r, c, similarity = r[order], c[order], similarity[order]
            first = np.searchsorted(r, r)  # where a query's own candidates begin
            keep = np.arange(len(r)) - first < k
            r, c, similarity = r[keep], c[keep], similarity[keep]
            yield batch(types, q=q[at + r], id=ids[c], similarity=np.ma.masked_array(similarity, n[at + r] < 0))

    found = blocks_across(asked, "q", s, "id", near, f"q {kinds[0]}, id {kinds[1]}, similarity double")
    found = found if least is None else found.where(F.col("similarity") >= least)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def retrieval_chain(queries: DataFrame, store: DataFrame, k: int = 5, steps: int = 5, settle: float = 1e-3) -> DataFrame:
    """Each query replaced by the softmax-weighted mean of its k nearest vectors, again and again until it stays, at most
    `steps` times; all queries together. Gives (q, v, steps)."""
    state = queries.select("q", "v", F.lit(0).alias("steps"), F.lit(False).alias("done"))
    for _ in range(steps):
        top = cosine_top_k(state.where("not done").select("q", "v"), store, k).join(store.select("id", F.col("v").alias("_v")), "id")
        total = Window.partitionBy("q")
        parts = top.withColumn("_w", F.exp("similarity") / F.sum(F.exp("similarity")).over(total)).select("q", "_w", F.posexplode("_v").alias("i", "x"))
        mean = parts.groupBy("q", "i").agg(F.sum(F.col("_w") * F.col("x")).alias("x")).groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda a: a["x"]).alias("_n"))
        moved = state.join(mean, "q", "left")
        new = F.coalesce("_n", "v")
        state = moved.select("q", new.alias("v"), (F.col("steps") + F.when(F.col("done"), 0).otherwise(1)).alias("steps"), (F.col("done") | (1 - market.cosine(new, F.col("v")) < settle)).alias("done"))
        state = written(state, "retrieved")  # each step reads it twice, so that without it the work would double with every step
    return state.select("q", "v", "steps")


def incremental(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the journal yet."""
    return new.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])
