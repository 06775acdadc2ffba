"""Profiles of sources as a table, what is known of a source by its articles, and summaries of repositories and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import lexicons as lex
from tidegauge.functions import text as tx
from tidegauge.operators.blocks import TILE, added, apart, batch, block_pairs, matrix, rounded, tiles, widened
from tidegauge.operators.joins import cosine_top_k
from tidegauge.operators.ordering import numbered
from tidegauge.operators.statistics import gram

PROFILE = "ord int, domain string, fetcher string, wait double, parser string, adaptive boolean, needs_scripts boolean"


def default_profiles(spark: SparkSession) -> DataFrame:
    """The listed source profiles, in the order in which they are tried."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(lex.PROFILES)], PROFILE)


def with_profiles(profiles: DataFrame, own: DataFrame) -> DataFrame:
    """Profiles with one's own rows: a row for a domain that is listed takes its place, others are tried after the rest, in
    their own order. Of repeated own rows of a domain the last counts."""
    last = own.groupBy("domain").agg(F.max_by(F.struct(*[c for c in own.columns if c not in ("domain", "ord")]), "ord").alias("_own"), F.min("ord").alias("_first"))
    fields = [c for c in profiles.columns if c not in ("domain", "ord")]
    base = profiles.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_most"))
    both = profiles.join(last, "domain", "full_outer").join(F.broadcast(base), F.lit(True))
    at = F.coalesce(F.col("ord"), F.col("_most") + 1 + F.col("_first")).alias("ord")
    return both.select(at, "domain", *[F.when(F.col("_own").isNotNull(), F.col(f"_own.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def match_source(pages: DataFrame, profiles: DataFrame, url: str = "url") -> DataFrame:
    """Adds `profile`, the first profile whose domain is part of the URL's host; null where none is. Each different host is
    looked up once: its parts of the lengths that domains have meet the domains by equality."""
    lengths = [r[0] for r in profiles.select(F.length("domain").alias("n")).distinct().where("n between 1 and 253").orderBy("n").collect()]  # at most 253 numbers
    host = F.coalesce(tx.host(F.col(url)), F.lit(""))
    hosts = pages.select(host.alias("_host")).distinct()

    def of_length(n: int):
        cut = F.transform(F.sequence(F.lit(1), F.length("_host") - n + 1), lambda i: F.substr("_host", i, F.lit(n)))
        return F.when(F.length("_host") >= n, cut).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*[of_length(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    parts = hosts.select("_host", F.explode(F.array_distinct(pieces)).alias("domain"))
    found = parts.join(profiles, "domain").groupBy("_host").agg(F.min_by(F.struct(*profiles.columns), "ord").alias("profile"))
    return pages.withColumn("_host", host).join(found, "_host", "left").drop("_host")


def source_moments(df: DataFrame, source: str, measures: list[str]) -> DataFrame:
    """(source, n, mean and population deviation of each measure)."""
    return df.groupBy(source).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{name}") for m in measures for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def fit_transfer(df: DataFrame, source: str, x: str, y: str, hours: str | None = None, ridge: float = 1.0) -> DataFrame:
    """(source, n, weights, bias, r2, amplification, inflation, decay): how far a source's vectors x foretell the number y.

    Weights solve the ridge equations of raw sums; the bias makes means agree. Amplification is the deviation of what is
    foretold over that of y, inflation is by how much it is larger, decay is the median of `hours`, 0.1 at least. Sources
    with fewer than three rows have no weights, with fewer than four no decay. All but the median comes from one table of
    sums of products a source, of which one small matrix is solved; the median is found by numbering the hours."""
    import numpy as np
    import pandas as pd

    kind = df.schema[source].dataType.simpleString()
    z = df.select(source, F.concat(F.col(x).cast("array<double>"), F.array(F.col(y).cast("double"))).alias("_z"))

    def solve(frames):
        for pdf in frames:
            out = []
            for s, n, sums, products in zip(pdf[source], pdf["n"], pdf["sums"], pdf["products"], strict=True):
                d = len(sums)
                g, m = np.asarray(products).reshape(d, d), np.asarray(sums) / n
                if n < 3:
                    out.append((s, int(n), None, 0.0, 0.0, 1.0, 0.0))
                    continue
                w = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(d - 1), g[:-1, -1])
                c = g - n * np.outer(m, m)
                actual, told = max(c[-1, -1], 0.0), max(w @ c[:-1, :-1] @ w, 0.0)
                left = actual - 2 * w @ c[:-1, -1] + told
                a, t = (actual / n) ** 0.5, (told / n) ** 0.5
                out.append((s, int(n), w.tolist(), float(m[-1] - w @ m[:-1]), float(1 - left / max(actual, 1e-15)), float(t / max(a, 1e-15)), float(max(0.0, t - a))))
            yield pd.DataFrame(out, columns=[source, "n", "weights", "bias", "r2", "amplification", "inflation"])

    fits = gram(z, [source], "_z").mapInPandas(solve, f"{source} {kind}, n long, weights array<double>, bias double, r2 double, amplification double, inflation double")
    if hours is None:
        return fits.withColumn("decay", F.lit(None).cast("double"))
    placed = numbered(df.where(F.col(hours).isNotNull()).select(source, F.col(hours).cast("double").alias("_h")), [source], ["_h"])
    middle = placed.where((F.col("ordinal") == F.floor((F.col("group_rows") - 1) / 2)) | (F.col("ordinal") == F.floor(F.col("group_rows") / 2)))
    median = middle.groupBy(F.col(source).alias("_s")).agg(F.when(F.max("group_rows") > 3, F.greatest(F.avg("_h"), F.lit(0.1))).alias("decay"))
    return fits.join(median, fits[source].eqNullSafe(median["_s"]), "left").drop("_s")


def article_batch(articles: DataFrame, by: str, tickers: str, sentiment: str) -> tuple[DataFrame, DataFrame]:
    """((by, n, n_tickers, mean_sentiment), (by, ticker)): batches in short, and their different tickers as rows, of which
    there may be any number."""
    found = articles.select(by, F.explode(tickers).alias("ticker")).distinct()
    counts = found.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n_tickers"))
    means = articles.groupBy(by).agg(F.count("*").alias("n"), F.avg(sentiment).alias("mean_sentiment"))
    short = means.join(counts, means[by].eqNullSafe(counts["_by"]), "left").select(by, "n", F.coalesce("n_tickers", F.lit(0)).alias("n_tickers"), "mean_sentiment")
    return short, found


def uncovered(patterns: DataFrame, registry: DataFrame, key: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """((prefix, uncovered), (key)): registered ids without a pattern, counted by prefix, and the first `most` of them."""
    left = registry.select(key).distinct().join(patterns.select(key), key, "left_anti")
    return left.groupBy(F.split(key, "_")[0].alias("prefix")).agg(F.count("*").alias("uncovered")), left.orderBy(key).limit(most)


def repo_insights(files: DataFrame, repo: str, path: str, most: int = 10) -> DataFrame:
    """(repo, language, n_files, directories): the commonest file extension (`unknown` without one; ties by name), how many
    files have it, and the first `most` top directories by name."""
    name = F.element_at(F.split(path, "/"), -1)
    ends = files.select(repo, F.regexp_extract(name, r"^.+\.([^.]+)$", 1).alias("ext")).groupBy(repo, "ext").agg(F.count("*").alias("n"))
    top = ends.groupBy(repo).agg(F.min(F.when(F.col("ext") != "", F.struct((-F.col("n")).alias("n"), F.col("ext").alias("ext")))).alias("m"))
    dirs = files.where(F.contains(F.col(path), F.lit("/"))).select(F.col(repo).alias("_r"), F.split(path, "/")[0].alias("d")).where("d <> ''").distinct()
    # Names are few in a repository; the least ones are kept while they are gathered.
    least = F.slice(F.array_sort(F.collect_set("d")), 1, most)
    return top.join(dirs.groupBy("_r").agg(least.alias("directories")), F.col(repo).eqNullSafe(F.col("_r")), "left").select(
        repo, F.coalesce("m.ext", F.lit("unknown")).alias("language"), F.coalesce(-F.col("m.n"), F.lit(0)).alias("n_files"), F.coalesce("directories", F.array().cast("array<string>")).alias("directories"))


def match_template(new: DataFrame, stored: DataFrame, least: float = 0.75) -> DataFrame:
    """(q, template, similarity): each vector's nearest stored one by cosine, where that is over `least`. new: (q, v),
    stored: (id, v)."""
    best = cosine_top_k(new, stored, 1).where(F.col("similarity") > least)
    return best.select("q", F.col("id").alias("template"), "similarity")


def equivalent_pairs(df: DataFrame, key: str, spectrum: str, threshold: float = 0.3, digits: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b whose sorted spectra, padded with zeros, are nearer than `threshold` in the mean;
    rounded to `digits` where these are.

    The distance of two spectra is at least that of their sums over the longer length, so that pairs this near lie in the
    same or in neighbouring bands of sums. Bands meet block by block; there the sums of up to sixteen runs of parts of both
    spectra, short ones where parts are large, whose distance is never the larger one, leave the pairs whose distances are
    added up, in single precision first if that can tell some."""
    kind, part = df.schema[key].dataType.simpleString(), df.schema[spectrum].dataType.elementType.simpleString()
    size = F.transform(spectrum, lambda v: F.abs(v) if part == "float" else F.abs(v).cast("double"))
    s = df.select(F.col(key).alias("k"), F.sort_array(size, asc=False).alias("x")).where("k is not null and size(x) > 0")
    longest = s.agg(F.max(F.size("x")).alias("_longest"))
    s = s.join(F.broadcast(longest), F.lit(True)).select("k", "x", F.floor(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / (threshold * F.col("_longest"))).alias("band")).where("band is not null")
    # a pair meets in the lower of its bands, where the upper one's rows do not meet each other
    rows = s.select("k", "x", F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("own")))).alias("b")).select("k", "x", "b.band", "b.own")

    def near(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        types = {"a": left.schema.field("k").type, "b": left.schema.field("k").type}
        (x, n), (y, m) = matrix(left["x"]), matrix(right["x"])
        width = max(x.shape[1], y.shape[1])
        x, y = widened(x, width), widened(y, width)
        parts = np.unique((np.linspace(0, 1, 16, endpoint=False) ** 2 * width).astype(int))
        xp, yp = (np.add.reduceat(z, parts, axis=1) for z in (x, y))
        most = xp.sum(1).max(initial=0.0) + yp.sum(1).max(initial=0.0)
        room = lambda t: 2 * width * float(np.finfo(t).eps) * most  # noqa: E731  for rounding
        single = np.float32 if room(np.float32) < 0.05 * threshold * width else np.float64
        xp, yp, xs, ys, ones = np.ascontiguousarray(xp.T), np.ascontiguousarray(yp.T), x.astype(single), y.astype(single), np.ones(width, dtype=single)
        step = most / 30_000  # sums in steps are whole numbers of 16 bits, if that tells enough apart
        whole = 0 < step * len(parts) < 0.1 * threshold * width
        if whole:
            xp, yp = (np.rint(z / step).astype(np.int16) for z in (xp, yp))
        pad = np.empty((2, 2 * TILE if whole else TILE), dtype=xp.dtype)
        i, j = left["k"].to_numpy(), right["k"].to_numpy()
        mine, theirs = (np.flatnonzero(t["own"].to_numpy()) for t in (left, right))
        guests, others = (np.flatnonzero(~t["own"].to_numpy()) for t in (left, right))

        def off(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            """Totals of the rows r of x less the rows c of y, some at a time."""
            out = np.empty(len(r), dtype=x.dtype)
            for at in range(0, len(r), 512):
                d = np.take(x, r[at : at + 512], axis=0)
                d -= np.take(y, c[at : at + 512], axis=0)
                out[at : at + 512] = total(np.abs(d, out=d))
            return out

        def told(r: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.maximum(n[r], m[c])
            maybe = ~(off(xs, ys, r, c, lambda d: d @ ones) > threshold * size + room(single))
            r, c, size = r[maybe], c[maybe], size[maybe]
            distance = off(x, y, r, c, added) / size
            keep = distance < threshold
            r, c, distance = i[r[keep]], j[c[keep]], distance[keep]
            less, more = (r < c).astype(bool), (r > c).astype(bool)
            a, b = np.where(less, r, c), np.where(less, c, r)
            if not (less | more).all():  # keys that are not one row's alone
                a, b, distance = (z[less | more] for z in (a, b, distance))
            if len(a):
                yield batch(types, a=a, b=b, distance=distance if digits is None else rounded(distance, digits))

        def met(p: np.ndarray, q: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
            u, v, long, wide = np.take(xp, p, axis=1), np.take(yp, q, axis=1), n[p], m[q]
            alike = len(p) and len(q) and long.min() == long.max() == wide.min() == wide.max()
            found, pending = [], 0
            for some, first in tiles(len(p), len(q), same, pad.shape[1]):
                far = threshold * (long[0] if alike else np.maximum(long[some, None], wide[None, first:]))
                # half a step is lost at either end; what is not a number is told below
                far = np.minimum(far / step + len(parts) + 1, 32_000).astype(np.int16) if whole else far + room(np.float64)
                close = ~(apart(u[:, some], v[:, first:], pad) > far)
                r, c = np.divmod(np.flatnonzero(close), max(close.shape[1], 1))
                r, c = r + some.start, c + first
                if same:
                    above = c > r
                    r, c = r[above], c[above]
                found.append((p[r], q[c]))
                pending += len(r)
                if pending >= TILE:
                    yield from told(*(np.concatenate(z) for z in zip(*found, strict=True)))
                    found, pending = [], 0
            if pending:
                yield from told(*(np.concatenate(z) for z in zip(*found, strict=True)))

        yield from met(mine, theirs, same)
        yield from met(mine, others, False)
        if not same:
            yield from met(guests, theirs, False)

    return block_pairs(rows, "k", near, f"a {kind}, b {kind}, distance double", ["band"], most=32768)


def repo_summary(repos: DataFrame, key: str, description: str, readme: str, files: str) -> DataFrame:
    """(key, intent, workflow, key_files, file_patterns) of repositories.

    The intent is a description of over 20 characters, else the first paragraph among eight that is no heading, has no badge
    and is of 30 characters or more, cut at 300. The workflow is the numbered or commented steps of the usage section (over 5
    characters, cut at 80, eight at most), else stages told by file names, else three general ones. Nulls are as empty."""
    d, text, paths = F.coalesce(description, F.lit("")), F.coalesce(readme, F.lit("")), F.coalesce(files, F.array().cast("array<string>"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    paragraphs = F.transform(F.slice(F.split(text, "\n\n"), 1, 8), strip)
    fit = F.filter(paragraphs, lambda p: ~p.startswith("#") & ~F.contains(p, F.lit("![")) & (F.length(p) >= 30))
    none = F.concat(F.lit("GitHub repository ("), F.coalesce(F.nullif(d, F.lit("")), F.lit("no description")), F.lit(")"))
    intent = F.when(F.length(d) > 20, F.left(d, F.lit(300))).otherwise(F.coalesce(F.left(F.get(fit, F.lit(0)), F.lit(300)), none))
    usage = F.regexp_extract(text, r"(?is)##\s*(?:Usage|Quick[- ]?Start|Getting Started|Example)(.*?)(?=##|\z)", 1)
    steps = F.transform(F.regexp_extract_all(usage, F.lit(r"(?m)((?:^\d+\.\s*.+|#\s*.+))$"), F.lit(1)), lambda m: strip(F.regexp_replace(m, r"^(?:\d+\.\s*|#\s*)", "")))
    steps = F.slice(F.transform(F.filter(steps, lambda s: F.length(s) > 5), lambda s: F.left(s, F.lit(80))), 1, 8)
    depth = lambda p: F.size(F.split(p, "/"))
    patterns = F.slice(F.array_sort(F.array_distinct(F.filter(paths, lambda p: (p.endswith(".py") & (depth(p) <= 3)) | p.isin(lex.PROJECT_FILES)))), 1, 30)
    any_of = lambda *ws: F.exists("file_patterns", lambda f: F.lower(f).rlike("|".join(ws)))
    stages = F.array_compact(F.array(F.when(any_of("load", "read", "input"), "load_input"), F.when(any_of("process", "transform", "train"), "process"), F.when(any_of("output", "export", "save"), "output")))
    general = F.array(*[F.lit(s) for s in ("initialize", "execute", "output")])
    key_files = F.slice(F.filter(paths, lambda p: F.element_at(F.split(p, "/"), -1).rlike(f"(?i){lex.KEY_FILES}")), 1, 10)
    out = repos.select(key, intent.alias("intent"), steps.alias("_steps"), key_files.alias("key_files"), patterns.alias("file_patterns"))
    work = F.when(F.size("_steps") > 0, F.col("_steps")).when(F.size(stages) > 0, stages).otherwise(general)
    return out.select(key, "intent", work.alias("workflow"), "key_files", "file_patterns")
