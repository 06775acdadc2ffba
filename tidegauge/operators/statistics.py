"""Aggregations: features, profiles, sweeps, cross-validation, skylines, fits."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.spectral import trust_score
from tidegauge.operators.blocks import MOST_ROWS, in_blocks, matrix
from tidegauge.operators.store import written


def assemble_features(long: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long name/value rows as one wide row a key, in fixed order, missing ones 0, and as `features`."""
    wide = long.groupBy(*key).pivot(name, names).agg(F.max(value)).fillna(0.0, names)
    return wide.withColumn("features", F.array(*[F.col(f"`{n}`") for n in names]))


def gram(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, n, sums, products): counts, sums and row-major sums of products of vectors, folded within partitions first."""
    dims = df.select(*key, F.posexplode(vector).alias("_i", "_x"), F.col(vector).alias("_v"))
    sums = dims.groupBy(*key, "_i").agg(F.count("*").alias("_n"), F.sum("_x").alias("_s"))
    pairs = dims.select(*key, "_i", "_x", F.posexplode("_v").alias("_j", "_y")).groupBy(*key, "_i", "_j").agg(F.sum(F.col("_x") * F.col("_y")).alias("_p"))
    row = sums.groupBy(*key).agg(F.max("_n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda a: a["_s"]).alias("sums"))
    products = pairs.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_j", "_p"))), lambda a: a["_p"]).alias("products"))
    return row.join(products, key)


def source_profile(df: DataFrame, source: str, vector: str) -> DataFrame:
    """(source, n, mean, cov): mean vector and covariance over n - 1, with 1e-6 on the diagonal where n <= dim."""
    g = gram(df, [source], vector)
    dim = F.size("sums")
    mean = F.transform("sums", lambda s: s / F.col("n"))
    cov = F.transform("products", lambda p, k: (p - F.get("sums", F.floor(k / dim).cast("int")) * F.get("sums", (k % dim).cast("int")) / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)))
    ridge = F.transform(cov, lambda c, k: F.when((F.col("n") <= dim) & (F.floor(k / dim) == k % dim), c + 1e-6).otherwise(c))
    return g.select(source, "n", mean.alias("mean"), ridge.alias("cov"))


def spectral_summary(profile: DataFrame, source: str, k: int) -> DataFrame:
    """(source, eigenvalues, concentration, effective_rank) of each source's covariance; one small matrix a source."""
    kind = profile.schema[source].dataType.simpleString()

    def solve(frames):
        for pdf in frames:
            out = []
            for s, c in zip(pdf[source], pdf["cov"], strict=True):
                d = int(round(len(c) ** 0.5))
                e = np.clip(np.linalg.eigvalsh(np.asarray(c).reshape(d, d))[::-1], 0, None)
                p = e / e.sum() if e.sum() > 0 else np.zeros(d)
                out.append((s, e[:k].tolist(), float(p[0]), float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))))
            yield pd.DataFrame(out, columns=[source, "eigenvalues", "concentration", "effective_rank"])

    return profile.select(source, "cov").mapInPandas(solve, f"{source} {kind}, eigenvalues array<double>, concentration double, effective_rank double")


def _weighted(z: Column, weight: str | None) -> Column:
    return z if weight is None else F.transform(z, lambda a: a * F.sqrt(F.col(weight)))


def fit_linear(df: DataFrame, key: list[str], x: str, y: str, ridge: float = 1e-3, weight: str | None = None) -> DataFrame:
    """(key, n, weights row-major (outputs by inputs + bias), r2): ridge regression of vectors y on vectors x, solved on
    aggregated sums of one small matrix a key; rows may have weights."""
    both = df.withColumn("_z", _weighted(F.concat(F.array(F.lit(1.0)), F.col(x).cast("array<double>"), F.col(y).cast("array<double>")), weight))
    sizes = both.groupBy(*key).agg(F.max(F.size(x)).alias("dx"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def solve(frames):
        for pdf in frames:
            out = []
            for _, r in pdf.iterrows():
                d = len(r["sums"])
                g, p = np.asarray(r["products"]).reshape(d, d), int(r["dx"]) + 1
                xx, xy, yy = g[:p, :p], g[:p, p:], np.diag(g[p:, p:])
                hold = ridge * np.eye(p)
                hold[0, 0] = 0
                w = np.linalg.lstsq(xx + hold, xy, rcond=None)[0]
                total = yy - g[0, p:] ** 2 / max(g[0, 0], 1e-12)
                error = yy - 2 * (w * xy).sum(0) + np.einsum("ij,ik,kj->j", w, xx, w)
                r2 = float(1 - error.sum() / total.sum()) if total.sum() > 1e-12 else 0.0
                out.append((*[r[k] for k in key], int(r["n"]), w.T.ravel().tolist(), r2))
            yield pd.DataFrame(out, columns=[*key, "n", "weights", "r2"])

    return gram(both, key, "_z").join(sizes, key).mapInPandas(solve, f"{kinds}, n long, weights array<double>, r2 double")


def fit_lift(pairs: DataFrame, key: list[str], x: str, y: str, ridge: float = 1.0, most_rank: int = 4, bound: float = 0.9, weight: str | None = None) -> DataFrame:
    """(key, n, matrix row-major (outputs by inputs), rank, radius): ridge regression without bias of vectors y on vectors
    x, of rows that may have weights, cut to its leading singular directions and scaled down where the largest singular value is over the bound. Keys
    with fewer than three pairs have none. Sums are aggregated; one small matrix a key is solved."""
    both = pairs.withColumn("_z", _weighted(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")), weight))
    sizes = both.groupBy(*key).agg(F.max(F.size(x)).alias("dx"))
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key)

    def solve(frames):
        for pdf in frames:
            out = []
            for _, r in pdf.iterrows():
                d, p = len(r["sums"]), int(r["dx"])
                g = np.asarray(r["products"]).reshape(d, d)
                u, size, v = np.linalg.svd(np.linalg.solve(g[:p, :p] + ridge * np.eye(p), g[:p, p:]).T, full_matrices=False)
                rank = max(1, min(most_rank, int((size > 1e-10 * size[0]).sum())))
                size = size[:rank] * min(1.0, bound / max(size[0], 1e-15))
                out.append((*[r[k] for k in key], int(r["n"]), ((u[:, :rank] * size) @ v[:rank]).ravel().tolist(), rank, float(size[0])))
            yield pd.DataFrame(out, columns=[*key, "n", "matrix", "rank", "radius"])

    return gram(both, key, "_z").where("n >= 3").join(sizes, key).mapInPandas(solve, f"{kinds}, n long, matrix array<double>, rank int, radius double")


def _times(matrix: Column, x: Column) -> Column:
    """A row-major matrix by a vector."""
    d = F.size(x)
    row = lambda i: F.aggregate(F.zip_with(F.slice(matrix, i * d + 1, d), x.cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    return F.when(matrix.isNotNull(), F.transform(F.sequence(F.lit(0), (F.size(matrix) / d).cast("int") - 1), row))


def apply_lift(df: DataFrame, lift: DataFrame, key: list[str], x: str) -> DataFrame:
    """Adds `lifted`: the lift of a row's key applied to its vector; null where the key has none."""
    return df.join(lift.select(*key, "matrix"), key, "left").withColumn("lifted", _times(F.col("matrix"), F.col(x))).drop("matrix")


def fit_calendar_stages(pairs: DataFrame, channels: DataFrame, key: str, x: str, y: str, kappa: float = 2.0, least_weight: float = 0.01, least_rows: int = 5, ridge: float = 1.0, most_rank: int = 4, bound: float = 0.9) -> DataFrame:
    """(channel, n, matrix, rank, radius): a lift of y on x over all pairs, as the channel `base`, and for each calendar
    channel a weighted lift of what the first one leaves, over pairs that weigh more than `least_weight` (von Mises in the
    phase), if there are `least_rows`. Where the sum of all, every channel at full weight, has a singular value over the
    bound, the channels' lifts are scaled by the bound over it, less a hundredth. channels: (key, channel, theta,
    amplitude)."""
    from tidegauge.functions.spectral import von_mises

    base = written(fit_lift(pairs.withColumn("channel", F.lit("base")), ["channel"], x, y, ridge, most_rank, bound), "calendar-base")
    met = pairs.join(F.broadcast(base.select("matrix")), F.lit(True))  # one row
    left = met.select(key, x, F.zip_with(y, _times(F.col("matrix"), F.col(x)), lambda a, b: a - b).alias("_left"))
    rows = left.join(channels, key).withColumn("_w", von_mises(F.col("amplitude"), F.col("theta"), kappa)).where(F.col("_w") > least_weight)
    cycles = fit_lift(rows, ["channel"], x, "_left", ridge, most_rank, bound, "_w").where(F.col("n") >= least_rows)
    both = written(base.unionByName(cycles), "calendar-lifts")
    whole = both.select(F.posexplode("matrix").alias("i", "a")).groupBy("i").agg(F.sum("a").alias("a")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda c: c["a"]).alias("total"))
    sizes = pairs.agg(F.max(F.size(x)).alias("d"))

    def ratio(frames):
        for pdf in frames:
            tops = [np.linalg.norm(np.asarray(t).reshape(-1, int(d)), 2) if len(t) else 0.0 for t, d in zip(pdf["total"], pdf["d"], strict=True)]
            yield pd.DataFrame({"ratio": [bound / top * 0.99 if top > bound else 1.0 for top in tops]})

    scale = whole.join(F.broadcast(sizes), F.lit(True)).where("d is not null").mapInPandas(ratio, "ratio double")  # one row each
    by = F.when(F.col("channel") == "base", 1.0).otherwise(F.col("ratio"))
    return both.join(F.broadcast(scale), F.lit(True)).select("channel", "n", F.transform("matrix", lambda a: a * by).alias("matrix"), "rank", (F.col("radius") * by).alias("radius"))


def edmd_pairs(df: DataFrame, series: str, order: str, vector: str, degree: int = 2) -> DataFrame:
    """Adds `psi` and `psi_next`: polynomial bases (1, x, products of two) of a row and the one after it; x itself for
    degree 0."""
    basis = lambda v: v if degree == 0 else F.concat(F.array(F.lit(1.0)), v, *([F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda b: a * b)))] if degree > 1 else []))
    rows = df.withColumn("psi", basis(F.col(vector).cast("array<double>")))
    return rows.withColumn("psi_next", F.lead("psi").over(Window.partitionBy(series).orderBy(order))).where("psi_next is not null")


def _spectra(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Operators, their eigenvalues from the largest on, and the three parts of the scaled sums, of sums of products of bases
    and the next rows' bases; leading axes are systems."""
    k = sums.shape[-1] // 2
    full = sums / np.maximum(sums[..., :1, :1], 1e-12)  # the constant's square: the number of pairs, or their weight
    g, a, b = full[..., :k, :k], full[..., :k, k:], full[..., k:, k:]
    op = np.linalg.pinv(g, rcond=1e-10) @ a
    e = np.linalg.eigvals(op).astype(complex)
    return op, np.take_along_axis(e, np.lexsort((e.imag, e.real, -np.abs(e)), axis=-1), -1), (g, a, b)


def _edmd_quality(op: np.ndarray, e: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gap, error and condition of what `_spectra` gives."""
    g, a, b = parts
    size, turned = np.abs(e), np.swapaxes(op, -1, -2)
    gap = (size[..., 0] - size[..., 1]) / np.maximum(size[..., 0], 1e-12) if size.shape[-1] > 1 else np.ones(size.shape[:-1])
    trace = lambda m: np.trace(m, axis1=-2, axis2=-1)
    off = trace(b) - 2 * trace(turned @ a) + trace(turned @ g @ op)
    return gap, np.sqrt(np.maximum(off, 0.0) / np.maximum(trace(b), 1e-12)), np.linalg.cond(g)


def _edmd_solve(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, operator, re, im, gap, error, condition) from pairs whose `_z` is a basis and the next row's basis."""

    def solve(frames):
        for pdf in frames:
            out = []
            for _, r in pdf.iterrows():
                d = len(r["sums"])
                op, e, parts = _spectra(np.asarray(r["products"]).reshape(d, d))
                gap, error, condition = (float(x) for x in _edmd_quality(op, e, parts))
                out.append((*[r[c] for c in keys], int(r["n"]), op.ravel().tolist(), e.real.tolist(), e.imag.tolist(), gap, error, condition))
            yield pd.DataFrame(out, columns=[*keys, "m", "operator", "re", "im", "gap", "error", "condition"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keys)
    return gram(pairs, keys, "_z").mapInPandas(solve, f"{kinds}, m long, operator array<double>, re array<double>, im array<double>, gap double, error double, condition double")


def edmd_fit(df: DataFrame, series: str, order: str, vector: str, degree: int = 2, weight: str | None = None) -> DataFrame:
    """(series, m, operator, re, im, gap, error, condition): K with psi_k K ~ psi_k+1 from the pairs' products; sums are
    aggregated, and one small problem a series is solved; a pair may have its first row's weight."""
    pairs = edmd_pairs(df, series, order, vector, degree).withColumn("_z", _weighted(F.concat("psi", "psi_next"), weight))
    return _edmd_solve(pairs, [series])


#: Rows of a series that are dealt together where its windows are worked out.
CHUNK_ROWS = 4096

#: Rows of windows, repeated for each window, that a task holds at once.
WINDOW_ROWS = 65_536


def _pair_windows(df: DataFrame, series: str, order: str, vector: str, width: int, stride: int, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(series, window, `schema`) of all whole windows of `width` rows, a new one every `stride` rows, that hold a pair of
    rows in a row with vectors, by `fn(x, paired, beside, at)`: vectors of rows in order, null parts as 0; whether a row and
    the next have vectors; numbers that go with a row; and where windows start. A series is dealt in chunks of some
    CHUNK_ROWS rows, and a row is copied only where two chunks meet, not for each window; `beside` adds the numbers, as `_beside`,
    after that, once a row."""
    by, each = Window.partitionBy(series), -(-max(CHUNK_ROWS, width) // stride)
    x = F.transform(F.col(vector).cast("array<double>"), lambda a: F.coalesce(a, F.lit(0.0)))
    rows = df.select(series, order, x.alias("_x")).withColumn("_n", F.count("*").over(by)).withColumn("_i", F.row_number().over(by.orderBy(order, "_x")).cast("long") - 1)
    at = F.floor(F.col("_i") / stride)
    first, last = F.greatest(F.ceil((F.col("_i") - width + 1) / stride), F.lit(0)), F.least(at, F.floor((F.col("_n") - width) / stride))
    rows = rows.where((F.col("_n") >= width) & (first <= last)).withColumn("_chunk", F.explode(F.sequence(F.floor(first / each), F.floor(last / each))))
    starts = (F.col("_i") % stride == 0) & (F.col("_i") + width <= F.col("_n")) & (F.floor(at / each) == F.col("_chunk"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks as the session has, however few the bytes
    dealt = rows.withColumn("window", F.when(starts, at).otherwise(-1)).repartition(n, series, "_chunk").sortWithinPartitions(series, "_chunk", "_i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for more in batches:
            t = pa.Table.from_batches([more]) if held is None else pa.concat_tables([held, pa.Table.from_batches([more])])
            whole = max(len(t) - width + 1, 0)
            held = t.slice(whole)  # all windows that start here are still to come
            window = t["window"].to_numpy()
            begun = np.flatnonzero(window[:whole] >= 0)
            if not len(begun) or width < 2:
                continue
            (x, sizes), (numbers, _), names = matrix(t["_x"]), matrix(t["_beside"]), t[series].combine_chunks()
            paired = (sizes[:-1] >= 0) & (sizes[1:] >= 0)
            begun = begun[np.lib.stride_tricks.sliding_window_view(paired, width - 1)[begun].any(1)]
            dims, most = np.lib.stride_tricks.sliding_window_view(sizes, width)[begun].max(1), max(1, WINDOW_ROWS // width)
            for d in np.unique(dims[dims > 0]):
                some = begun[dims == d]
                for at in (some[k : k + most] for k in range(0, len(some), most)):
                    yield pa.RecordBatch.from_pydict({series: names.take(pa.array(at)), "window": pa.array(window[at]), **fn(x[:, :d], paired, numbers, at)})

    ready = beside(dealt) if beside else dealt.withColumn("_beside", F.array().cast("array<double>"))
    return ready.select(series, "window", "_x", "_beside").mapInArrow(run, f"`{series}` {df.schema[series].dataType.simpleString()}, window long, {schema}")


def _window_sums(z: np.ndarray, paired: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(windows, sets, 2 k, 2 k): sums of products of the bases `z` of rows and their next ones, over the pairs of each window
    that starts at `at`; weights are (windows or 1, sets, pairs of a window)."""
    both = np.hstack([z[:-1], z[1:]]) * paired[:, None]
    d = both.shape[1]
    products = (both[:, :, None] * both[:, None, :]).reshape(-1, d * d)
    return (weights @ products[at[:, None] + np.arange(weights.shape[-1])]).reshape(len(at), -1, d, d)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def z_scored(df: DataFrame, key: str, vector: str) -> DataFrame:
    """df with its vectors' parts less their mean and over their deviation in their group; parts that hardly vary are only
    centred."""
    parts = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    scale = parts.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("_i", "_m", F.when(F.col("_s") < 1e-10, 1.0).otherwise(F.col("_s")).alias("_s")))).alias("_z"))
    return df.join(scale, F.col(key).eqNullSafe(F.col("_key"))).withColumn(vector, F.zip_with(vector, "_z", lambda x, z: (x - z["_m"]) / z["_s"])).drop("_key", "_z")


def windowed_edmd(df: DataFrame, series: str, order: str, vector: str, width: int, stride: int | None = None, degree: int = 1, most_condition: float = 1e6, over: float = 0.01) -> DataFrame:
    """(series, window, m, re, im, gap, error, condition, drift, trust, rejected) of every window of `width` rows, a new one
    every `stride` rows (a quarter of the width): the EDMD of the z-scored series. Values larger than 1 + `over` are put on
    the unit circle; drift is the distance of the two halves' magnitudes; windows of a condition over `most_condition` are
    rejected. A pair of rows is made once and counted, by numpy, in each window, and half, that holds both."""
    stride = stride or max(width // 4, 1)
    at = np.arange(width - 1)
    halves = np.array([at >= 0, at + 1 < width // 2, at >= width // 2], dtype=float)

    def fit(x: np.ndarray, paired: np.ndarray, _: np.ndarray, starts: np.ndarray) -> dict[str, pa.Array]:
        d = x.shape[1]
        basis = [x] if degree == 0 else [np.ones((len(x), 1)), x, *([x[:, [i]] * x[:, i:] for i in range(d)] if degree > 1 else [])]
        op, e, parts = _spectra(_window_sums(np.hstack(basis), paired, halves[None], starts))
        counts, size = paired[starts[:, None] + at] @ halves.T, np.abs(e)
        gap, error, condition = _edmd_quality(op[:, 0], e[:, 0], [p[:, 0] for p in parts])
        drift = np.where((counts[:, 1:] > 0).all(1), np.sqrt(((size[:, 1] - size[:, 2]) ** 2).sum(1)), 0.0)
        told = {"gap": gap, "error": error, "condition": condition, "drift": drift}
        return {"m": pa.array(counts[:, 0].astype(np.int64)), "re": _lists(e[:, 0].real), "im": _lists(e[:, 0].imag), **{c: pa.array(v) for c, v in told.items()}}

    rows = z_scored(df.select(series, order, F.col(vector).cast("array<double>").alias(vector)), series, vector)
    met = _pair_windows(rows, series, order, vector, width, stride, fit, "m long, re array<double>, im array<double>, gap double, error double, condition double, drift double")
    size = F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"]))
    shrink = lambda c: F.zip_with(c, size, lambda x, m: F.when(m > 1 + over, x / m).otherwise(x))
    trust = trust_score(F.col("gap"), F.col("error"), F.col("drift"), F.col("condition"))
    return met.select(series, "window", "m", shrink("re").alias("re"), shrink("im").alias("im"), "gap", "error", "condition", "drift", trust.alias("trust"), (F.col("condition") > most_condition).alias("rejected"))


def reduce_windows(windows: DataFrame, series: str, energy: float = 0.9) -> DataFrame:
    """(series, windows, rejected, re, im, kept, energy, gap, error, condition, trust): what a series' windows that are not
    rejected have in common. Magnitudes are medians over windows, phases those of the window whose trust is nearest to the
    median; the largest values are kept until they hold a share `energy` of all squares."""
    windows = written(windows, "windows")  # read four times
    sound = windows.where("NOT rejected")
    whole = windows.groupBy(series).agg(F.count_if(~F.col("rejected")).alias("windows"), F.count_if("rejected").alias("rejected"))
    told = sound.groupBy(series).agg(F.avg("error").alias("error"), F.percentile("condition", 0.5).alias("condition"), F.avg("trust").alias("trust"), F.percentile("trust", 0.5).alias("_middle"))
    parts = sound.select(series, F.posexplode(F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"]))).alias("_i", "_x"))
    sizes = parts.groupBy(series, "_i").agg(F.percentile("_x", 0.5).alias("_m")).groupBy(series).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda a: a["_m"]).alias("_sizes"))
    middle = sound.join(told.select(series, "_middle"), series).groupBy(series).agg(F.min_by(F.transform(F.arrays_zip("re", "im"), lambda z: F.atan2(z["im"], z["re"])), F.struct(F.abs(F.col("trust") - F.col("_middle")), "window")).alias("_phases"))
    out = whole.join(told, series, "left").join(sizes, series, "left").join(middle, series, "left")
    ranked = F.reverse(F.array_sort(F.zip_with("_sizes", "_phases", lambda m, p: F.struct(m.alias("m"), p.alias("p")))))
    square = lambda n: F.aggregate(F.slice("_ranked", 1, n), F.lit(0.0), lambda s, z: s + z["m"] * z["m"])
    out = out.withColumn("_ranked", ranked).withColumn("_all", square(F.size("_ranked")))
    share = lambda n: F.when(F.col("_all") > 1e-15, square(n) / F.col("_all")).otherwise(1.0)
    kept = F.array_min(F.filter(F.sequence(F.lit(1), F.size("_ranked")), lambda n: (share(n) >= energy) | (n == F.size("_ranked"))))
    out = out.withColumn("kept", F.when(F.col("_ranked").isNotNull(), kept))
    top = lambda f: F.transform(F.slice("_ranked", 1, F.col("kept")), f)
    gap = F.get("_ranked", F.lit(0))["m"] - F.coalesce(F.get("_ranked", F.lit(1))["m"], F.lit(0.0))
    return out.select(series, "windows", "rejected", top(lambda z: z["m"] * F.cos(z["p"])).alias("re"), top(lambda z: z["m"] * F.sin(z["p"])).alias("im"), "kept", F.when(F.col("kept").isNotNull(), share(F.col("kept"))).alias("energy"), gap.alias("gap"), "error", "condition", "trust")


def running_moments(df: DataFrame, key: str, order: str, vector: str, decay: float = 0.95) -> DataFrame:
    """(key, n, mean, cov) after each group's last row: an exponentially weighted mean, from the first row on, and the
    weighted mean of the products of what was off it, decay C + (1 - decay) d d^T with d the row less the mean that holds it.
    Means are an affine recurrence of each part, folded in chunks; the covariance is one weighted sum of products."""
    from tidegauge.operators.windows import linear_recurrence

    rows = df.select(key, order, F.posexplode(F.col(vector).cast("array<double>")).alias("_part", "_x"))
    means = linear_recurrence(rows, [key, "_part"], order, "_x", decay, 1.0 - decay, "_m")
    off = means.groupBy(key, order).agg(F.sort_array(F.collect_list(F.struct("_part", "_m", (F.col("_x") - F.col("_m")).alias("_d")))).alias("_v"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    weighed = off.withColumn("_w", F.sqrt((1.0 - decay) * F.pow(F.lit(decay), back))).withColumn("_z", F.transform("_v", lambda v: v["_d"] * F.col("_w")))
    last = off.groupBy(key).agg(F.transform(F.max_by("_v", order), lambda v: v["_m"]).alias("mean"))
    return gram(weighed, [key], "_z").join(last, key).select(key, "n", "mean", F.col("products").alias("cov"))


def fit_calendar_lift(pairs: DataFrame, channels: DataFrame, key: str, x: str, y: str, kappa: float = 2.0, least_weight: float = 0.01, least_rows: int = 5) -> DataFrame:
    """A weighted fit of y on x for each calendar channel: a pair counts by the channel's amplitude and nearness to its
    event (von Mises in the phase). channels: (key, channel, theta, amplitude)."""
    from tidegauge.functions.spectral import von_mises

    rows = pairs.join(channels, key).withColumn("_w", von_mises(F.col("amplitude"), F.col("theta"), kappa)).where(F.col("_w") > least_weight)
    return fit_linear(rows, ["channel"], x, y, weight="_w").where(F.col("n") >= least_rows)


def bootstrap_spectrum(df: DataFrame, series: str, order: str, vector: str, width: int = 60, stride: int = 5, draws: int = 20, seed: int = 0) -> DataFrame:
    """(series, window, lead, low, high, frequency, stability, variance): each window's leading eigenvalue with its 5 to 95 %
    range over replicates, in which every pair has a hash-drawn exponential weight; stability is the share of
    replicates in which it stays within the unit circle."""
    def weighed(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("_name", F.nullif(F.concat_ws(":", F.col(series).cast("string"), F.col(order).cast("string")), F.lit("")))  # once for all draws
        drawn = [-F.ln(F.greatest(hash_uniform(F.col("_name"), F.lit(r), F.lit(seed)), F.lit(1e-9))) for r in range(1, draws + 1)]
        return named.withColumn("_beside", F.array(F.lit(1.0), *drawn))

    def lead(x: np.ndarray, paired: np.ndarray, weights: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
        e = _spectra(_window_sums(x, paired, np.swapaxes(weights[at[:, None] + np.arange(width - 1)], 1, 2), at))[1][:, :, 0]
        size = np.abs(e)
        told = {"lead": size[:, 0], "frequency": np.abs(np.arctan2(e[:, 0].imag, e[:, 0].real))}
        if draws:
            size = np.sort(size[:, 1:], axis=1)
            told |= {"low": np.percentile(size, 5, axis=1), "high": np.percentile(size, 95, axis=1), "stability": (size <= 1.0 + 1e-9).mean(1), "variance": size.var(1)}
        return {c: pa.array(told[c]) if c in told else pa.nulls(len(at), pa.float64()) for c in ("lead", "low", "high", "frequency", "stability", "variance")}

    fit = _pair_windows(df, series, order, vector, width, stride, lead, "lead double, low double, high double, frequency double, stability double, variance double", weighed)
    return fit.select(F.col(series).cast("string").alias(series), "window", "lead", "low", "high", "frequency", "stability", F.coalesce("variance", F.lit(0.0)).alias("variance"))


def reharmonize(df: DataFrame, series: str, order: str, vector: str, scales: tuple[int, int, int] = (20, 40, 60), sigma: float = 0.1) -> DataFrame:
    """(series, ab, ac, bc, coherence): how well the leading frequencies of three window widths lock, pair by pair, over
    each series' windows; what a regime tracker takes as its vectors."""
    from tidegauge.operators.joins import coherence

    modes = [bootstrap_spectrum(df, series, order, vector, width=w, stride=max(1, w // 4)).select(F.col(series), F.col("window").alias("idx"), "frequency", "stability", "variance") for w in scales]
    out = None
    for name, a, b in (("ab", 0, 1), ("ac", 0, 2), ("bc", 1, 2)):
        lock = coherence(modes[a], modes[b], series, sigma).select(series, F.col("coherence").alias(name))
        out = lock if out is None else out.join(lock, series, "full")
    known = F.array_compact(F.array("ab", "ac", "bc"))
    return out.withColumn("coherence", F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1)))


def trial_stats(df: DataFrame, by: list[str], value: str, success: Column, exact: bool = True) -> DataFrame:
    p = (lambda q: F.percentile(F.when(success, F.col(value)), F.lit(q))) if exact else (lambda q: F.percentile_approx(F.when(success, F.col(value)), q, 10_000))
    v = F.when(success, F.col(value))
    return df.groupBy(*by).agg(
        F.count("*").alias("trials"), F.count_if(success).alias("successes"), (1 - F.count_if(success) / F.count("*")).alias("failure_rate"),
        F.avg(v).alias("mean"), p(0.5).alias("median"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.min(v).alias("least"), F.max(v).alias("most"),
    )


def sweep_summary(df: DataFrame, parameter: str, error: str, most: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(mean and largest error by parameter, the largest parameter that passes)."""
    by = df.groupBy(parameter).agg(F.avg(F.abs(error)).alias("mean_error"), F.max(F.abs(error)).alias("max_error"))
    return by, by.agg(F.max(F.when(F.col("max_error") < most, F.col(parameter))).alias("largest_passing"))


def fit_ratio(df: DataFrame, x: str, e: str, by: list[str] | None = None) -> DataFrame:
    """a = -sum(e x) / sum(x^2)."""
    return df.groupBy(*(by or [])).agg((-F.sum(F.col(e) * F.col(x)) / F.sum(F.col(x) * F.col(x))).alias("a"))


def leave_n_out(df: DataFrame, group: str, x: str, e: str, n: int = 2) -> DataFrame:
    """Every n groups held out: the ratio from the others, and the error |e + a x| on those held out. The training sums
    are the total less those held out; errors take one pass over the held-out rows."""
    sums = df.groupBy(group).agg(F.sum(F.col(e) * F.col(x)).alias("ex"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    total = sums.agg(F.sum("ex").alias("tex"), F.sum("xx").alias("txx"))
    held = sums.select(F.array(group).alias("groups"), "ex", "xx")
    for _ in range(n - 1):
        more = sums.select(F.col(group).alias("_g"), F.col("ex").alias("_ex"), F.col("xx").alias("_xx"))
        held = held.join(more, F.element_at("groups", -1) < F.col("_g")).select(F.concat("groups", F.array("_g")).alias("groups"), (F.col("ex") + F.col("_ex")).alias("ex"), (F.col("xx") + F.col("_xx")).alias("xx"))
    fits = held.join(F.broadcast(total), F.lit(True)).select("groups", (-(F.col("tex") - F.col("ex")) / (F.col("txx") - F.col("xx"))).alias("a"))
    tested = df.select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(e).alias("_e")).join(fits.select("groups", "a", F.explode("groups").alias("_g")), "_g")
    error = F.abs(F.col("_e") + F.col("a") * F.col("_x"))
    return tested.groupBy("groups", "a").agg(F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def cv_summary(fits: DataFrame, column: str = "a", most_range: float = 5.0) -> DataFrame:
    out = fits.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))
    out = out.withColumn("range_percent", (F.col("most") - F.col("least")) / F.abs("mean") * 100)
    return out.withColumn("stable", F.col("range_percent") < most_range)


def skyline(df: DataFrame, key: str, minimise: list[str], maximise: list[str] | None = None, fan: int = 8, most: int = MOST_ROWS) -> DataFrame:
    """Rows that no other row dominates; equal rows stay together. Each partition finds its own skyline, and these are merged
    `fan` at a time in a tree, until at most `most` rows are left for the last task. A skyline of more rows than that is
    compared with itself in blocks of a checked size instead."""
    cols = [*minimise, *(maximise or [])]
    sign = np.array([1.0] * len(minimise) + [-1.0] * len(maximise or []))

    def front(v: np.ndarray) -> np.ndarray:
        order, kept = np.lexsort(v.T[::-1]), []
        for i in order:
            if not kept or not ((v[kept] <= v[i]).all(1) & (v[kept] < v[i]).any(1)).any():
                kept.append(i)
        return np.array(sorted(kept), int)

    def local(frames):
        best = None
        for pdf in frames:
            best = pdf if best is None else pd.concat([best, pdf])
            best = best.iloc[front(best[cols].to_numpy(float) * sign)]
        if best is not None:
            yield best

    rows = df.select(key, *cols)
    some = written(rows.mapInPandas(local, rows.schema), "skyline")
    n, parts = some.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1 and n > most:
        parts, before = -(-parts // fan), n
        some = written(some.repartition(parts, *cols).mapInPandas(local, rows.schema), "skyline") if parts > 1 else some
        n = some.count()
        if n > 0.9 * before:  # merging takes little away: most of it is skyline
            break
    if n <= most:
        return some.coalesce(1).mapInPandas(local, rows.schema)
    other = some.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    no_worse = [F.col(f"_{c}") <= F.col(c) for c in minimise] + [F.col(f"_{c}") >= F.col(c) for c in maximise or []]
    better = [F.col(f"_{c}") < F.col(c) for c in minimise] + [F.col(f"_{c}") > F.col(c) for c in maximise or []]
    beats = functools.reduce(Column.__and__, no_worse) & functools.reduce(Column.__or__, better)
    beaten = in_blocks(other, f"_{cols[0]}", lambda block: some.join(block, beats, "left_semi").select(key))
    return some.join(beaten.distinct(), key, "left_anti")


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the parts' MD5: the same for every partitioning."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def monte_carlo(designs: DataFrame, key: str, r: str, l: str, c: str, tolerance: float, draws: int, seed: int = 0) -> DataFrame:  # noqa: E741
    """Uniform perturbations of series RLC designs: share of underdamped draws, spread and worst deviation of the natural
    frequency from the nominal one."""
    u = lambda part: 1 + tolerance * (2 * hash_uniform(F.col(key), F.col("draw"), F.lit(part), F.lit(seed)) - 1)
    drawn = designs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_r", F.col(r) * u("r")).withColumn("_l", F.col(l) * u("l")).withColumn("_c", F.col(c) * u("c"))
    w0, damping = 1 / F.sqrt(F.col("_l") * F.col("_c")), F.col("_r") / (2 * F.col("_l"))
    nominal = 1 / F.sqrt(F.col(l) * F.col(c))
    drawn = drawn.withColumn("_w", w0).withColumn("_under", damping < w0).withColumn("_dev", F.abs(w0 / nominal - 1))
    return drawn.groupBy(key).agg(F.avg(F.col("_under").cast("double")).alias("underdamped"), F.stddev_pop("_w").alias("spread"), F.max("_dev").alias("worst"))


def gaussian_mle(df: DataFrame, by: list[str], value: str, most: float) -> DataFrame:
    """Mean and deviation by group, their standard errors from the Fisher information, and whether both are known well."""
    s = F.stddev_pop(value)
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mu"), s.alias("sigma"), (s / F.sqrt(n)).alias("se_mu"), (s / F.sqrt(2 * n)).alias("se_sigma")).withColumn("promoted", (F.col("se_mu") < most) & (F.col("se_sigma") < most))


def fit_scaling(df: DataFrame, by: list[str], size: str, seconds: str) -> DataFrame:
    """Slope and intercept of log time over log size; (1, 0) with fewer than two usable rows."""
    ok = (F.col(size) > 0) & (F.col(seconds) > 0)
    x, y = F.when(ok, F.ln(size)), F.when(ok, F.ln(seconds))
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(1.0)).alias("slope"), F.when(F.regr_slope(y, x).isNull(), 0.0).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def rank_corr(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks within groups."""

    def ranked(c: str) -> Column:
        w = Window.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    rows = df.withColumn("_a", ranked(a)).withColumn("_b", ranked(b)).groupBy(*by).agg(F.corr("_a", "_b").alias("rho"))
    size = F.abs("rho")
    return rows.withColumn("strength", F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak"))


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(score).alias("mean_score"))


def crossing(profile: DataFrame, x: str = "mean_score", y: str = "rate", at: float = 0.5) -> DataFrame:
    """The first place where y crosses a level, by linear interpolation between bins; the profile is a few rows."""
    w = Window.partitionBy(F.lit(1)).orderBy(x)
    step = profile.select(F.lag(x).over(w).alias("x0"), F.col(x).alias("x1"), F.lag(y).over(w).alias("y0"), F.col(y).alias("y1")).where(((F.col("y0") < at) & (F.col("y1") >= at)) | ((F.col("y0") >= at) & (F.col("y1") < at)))
    return step.agg(F.min(F.col("x0") + (at - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("crossing"))


def scan_report(df: DataFrame, converged: Column, stable: Column, kind: str, frequency: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(converged).alias("converged"), F.avg(stable.cast("double")).alias("stable_fraction"), F.min(F.when(F.col(frequency) > 0, F.col(frequency))).alias("least_frequency"), F.max(F.when(F.col(frequency) > 0, F.col(frequency))).alias("most_frequency"))


def coverage(patterns: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """By the id's prefix: how many registered patterns there are, and how many of them are covered."""
    hit = registry.select(key).distinct().join(patterns.select(key, F.lit(1).alias("_hit")).distinct(), key, "left")
    return hit.groupBy(F.split(key, "_")[0].alias("prefix")).agg(F.count("*").alias("total"), F.count("_hit").alias("covered")).withColumn("percent", F.col("covered") / F.col("total") * 100)


def sparse_groups(registry: DataFrame, patterns: DataFrame, key: str, least: int) -> DataFrame:
    """Registered groups with fewer than `least` patterns, none included."""
    n = registry.select(key).distinct().join(patterns.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    return n.select(key, F.coalesce("_n", F.lit(0)).alias("n")).where(F.col("n") < least)


def subsets(values: list, n: int) -> list[tuple]:
    return list(itertools.combinations(values, n))
