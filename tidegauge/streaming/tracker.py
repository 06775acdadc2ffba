"""The chained tracker over a table: series are read once in order, and the spectra of a batch are worked out together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import spectral
from tidegauge.streaming.folds import BackboneFilter, ProfitWindows, Regimes, Spectra

#: Windows whose steps are solved at once; each has a matrix for every replicate.
WINDOWS = 256

TYPES = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def locks(spectra: np.ndarray, first: int, second: int, sigma: float, most: int = 15, stable: float = 0.6, steady: float = 0.05) -> np.ndarray:
    """`folds.lock_vector` of many spectra, (n, widths, modes, FIELDS)."""
    a, b = spectra[:, first], spectra[:, second]
    fit = lambda x: (x[:, :, 3] >= stable) & (x[:, :, 4] < steady) & ~np.isnan(x[:, :, 0])
    wi, wj = a[:, :, None, 0], b[:, None, :, 0]
    near = np.full(np.broadcast_shapes(wi.shape, wj.shape), np.inf)
    for p, q in spectral.rationals(10):
        near = np.minimum(near, np.abs(wi - p / q * wj))
    near = np.where((np.abs(wi) < 1e-12) | (np.abs(wj) < 1e-12), 0.0, near).reshape(len(a), -1)
    pairs = (fit(a)[:, :, None] & fit(b)[:, None, :]).reshape(len(a), -1)
    order = np.argsort(~pairs, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(pairs, order, 1), np.exp(-np.take_along_axis(near, order, 1) / sigma), 0.0)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])))


def leads(spectra: np.ndarray, sigma: float) -> list[tuple]:
    """(locks, coherence, frequency, amplitude) of each spectrum: the locks of the first two widths, or of the last two where
    these have none, the mean of those that are there, and the first width's leading stable mode."""
    near = locks(spectra, 0, 1, sigma)
    near = np.where((near > 0).any(1, keepdims=True), near, locks(spectra, 1, 2, sigma))
    total, n = np.zeros(len(near)), (near > 0).sum(1)
    for x in near.T:
        total += np.where(x > 0, x, 0.0)
    own = spectra[:, 0]
    stable = (own[:, :, 3] >= 0.6) & ~np.isnan(own[:, :, 0])
    lead, any_ = np.argmax(stable, axis=1), stable.any(1).tolist()
    at = np.arange(len(own))
    told = zip(near, (total / np.maximum(n, 1)).tolist(), own[at, lead, 0].tolist(), own[at, lead, 2].tolist(), any_, strict=True)
    return [(x, c, f if there else None, a if there else None) for x, c, f, a, there in told]


def track(df: DataFrame, key: str, order: str, vector: str, ret: str, idle: float | None, spectra: Spectra, sigma: float) -> DataFrame:
    """`folds.reharmonize` of a table."""
    regimes, backbone, windows = Regimes("locks", "coherence"), BackboneFilter("frequency", "amplitude", "settled"), ProfitWindows(ret, "switched")
    gives = ", ".join(["coherence double, frequency double, amplitude double", regimes.gives, backbone.gives, windows.gives])
    names, types = zip(*[g.split() for g in gives.split(", ")], strict=True)
    most = max(spectra.widths)

    def fresh() -> dict:
        return {"rows": None, "n": 0, "lead": (None, 0.0, None, None), "folds": (regimes.fresh(), backbone.fresh(), windows.fresh())}

    def worked_out(x: np.ndarray, s: dict, sums: dict[int, list[np.ndarray]]) -> list[tuple[int, list[tuple[int, int]]]]:
        """The rows of a series, given its state before them, that have spectra, and where the sums of their windows are."""
        rows = x if s["rows"] is None else np.concatenate([s["rows"], x])
        products, held, found = spectra.products(rows), len(rows) - len(x), []
        mine = sums.setdefault(products.shape[1], [])
        for t in range(len(x)):
            n = s["n"] + t + 1
            if spectra.due(n):
                seen = {}
                for w in spectra.widths:
                    size = min(w, n)
                    if size not in seen:  # widths of a young series are alike
                        seen[size] = len(mine)
                        mine.append(spectra.sums(products[: held + t], size, n))
                found.append((t, [(products.shape[1], seen[min(w, n)]) for w in spectra.widths]))
        s["rows"], s["n"] = rows[-most:], s["n"] + len(x)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, at = None, None, np.nan
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0).dictionary_encode("encode").indices)
            starts = np.diff(ids, prepend=ids[0]) != 0
            now = b.column(0)[0].as_py()
            starts[0] = state is None or not (now == last or (now != now and last != last))
            if idle is not None:
                times = np.array([np.nan if pd.isna(t) else (t.timestamp() if hasattr(t, "timestamp") else float(t)) for t in b.column(1).to_pandas()])
                starts |= np.diff(times, prepend=at) > idle
                at = times[-1]
            last = b.column(0)[b.num_rows - 1].as_py()
            parts = b.column(2)
            flat = np.asarray(parts.flatten().cast(pa.float64()))
            ends = np.cumsum([0, *pa.compute.list_value_length(parts).to_pylist()])
            sums, series, begins = {}, [], [0, *(i for i in np.flatnonzero(starts) if i)]
            for begin, end in zip(begins, [*begins[1:], b.num_rows], strict=True):
                state = fresh() if starts[begin] else state
                x = flat[ends[begin] : ends[end]].reshape(end - begin, -1)
                series.append((begin, end, state, worked_out(x, state, sums)))
            solved = {m: np.concatenate([spectra.spectra(np.array(z[i : i + WINDOWS])) for i in range(0, len(z), WINDOWS)]) for m, z in sums.items() if z}
            where = [w for *_, found in series for _, w in found]
            lead = iter(leads(np.array([[solved[m][i] for m, i in w] for w in where]), sigma) if where else [])
            returns, told = b.column(3).cast(pa.float64()).to_pylist(), []
            for begin, end, s, found in series:
                new = {begin + t for t, _ in found}
                for i in range(begin, end):
                    if i in new:
                        s["lead"] = next(lead)
                    own, coherence, frequency, amplitude = s["lead"]
                    one = regimes.step(s["folds"][0], own, coherence)
                    two = backbone.step(s["folds"][1], frequency, amplitude, one[0] >= 0)
                    told.append((coherence, frequency, amplitude, *one, *two, *windows.step(s["folds"][2], returns[i], one[1] == "switch")))
            new = [pa.array(c, type=TYPES[t]) for c, t in zip(zip(*told, strict=True), types, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), *new], names=[key, order, ret, *names])

    out = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, order, ret)] + [gives])
    # dealt and sorted as `states._in_order` does it, but to more tasks, as a row costs much and a hash deals series unevenly
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, order, vector, ret).repartition(n, F.xxhash64(key)).sortWithinPartitions(key, order).mapInArrow(run, out)
