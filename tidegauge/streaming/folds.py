"""Folds over series in order of time, as batches and as streams whose state is let go once a key has been idle.

A fold is a fresh state (a dictionary that JSON can hold) and a step that takes a row's values, changes the state and gives
the row's new columns. `fold` runs it over a table, a series at a time in sorted batches, or over a stream with one value of
state for each key, so that both give the same rows. Folds pass their input's columns on and can follow one another.

With `idle`, a row that comes more than so many seconds after its key's last one starts afresh. A stream then also sets a
timer for each key, and when the watermark has passed it, the state is removed. Rows behind the watermark are dropped by
Spark. Rows of one micro-batch are folded in order of time; an older row in a later one is folded when it comes. Null
values are each fold's own affair; a null time sorts first. In a stream, names of columns must not begin with an underscore.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions import spectral
from tidegauge.streaming.states import _in_order

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """needs: the input columns a step takes; gives: the columns it adds, as DDL."""

    needs: list[str]
    gives: str

    def fresh(self) -> dict:
        return {}

    def step(self, state: dict, *values) -> tuple:
        raise NotImplementedError


def _walk(f: Fold, order: str, idle: float | None, rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    names, told = [c.split()[0] for c in f.gives.split(", ")], []
    times = [None if pd.isna(t) else (t.timestamp() if hasattr(t, "timestamp") else float(t)) for t in rows[order]]
    for t, values in zip(times, zip(*[rows[c] for c in f.needs], strict=True), strict=True):
        if state is None or (idle is not None and t is not None and state["_at"] is not None and t - state["_at"] > idle):
            state = {**f.fresh(), "_at": None}
        told.append(f.step(state, *values))
        state["_at"] = t if t is not None else state["_at"]
    new = pd.DataFrame({n: pd.Series([r[i] for r in told], index=rows.index, dtype=object) for i, n in enumerate(names)}, index=rows.index)
    return pd.concat([rows, new], axis=1), state


class _Held(StatefulProcessor):
    """One key's fold in a stream."""

    def __init__(self, f: Fold, order: str, idle: float | None):
        self.fold, self.order, self.idle = f, order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("fold", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        frame, state = _walk(self.fold, self.order, self.idle, pd.concat(list(rows)).sort_values(self.order, na_position="first", kind="stable").reset_index(drop=True), state)
        self.state.update((json.dumps(state),))
        if self.idle is not None and state["_at"] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((state["_at"] + self.idle) * 1000) + 1)
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def fold(df: DataFrame, key: str, order: str, f: Fold, idle: float | None = None) -> DataFrame:
    """df with the fold's columns. A stream needs a watermark on `order` if `idle` is given or another fold follows; its
    session is set to keep state in RocksDB, which state with timers needs, unless it names a store of its own."""
    out = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns] + [f.gives])
    if not df.isStreaming:
        return _in_order(df, key, order, lambda _, rows, state: _walk(f, order, idle, rows.reset_index(drop=True), state), out)
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKS)
    timed = idle is not None or any("spark.watermarkDelayMs" in c.metadata for c in df.schema.fields)
    return df.groupBy(key).transformWithStateInPandas(_Held(f, order, idle), out, "Append", "EventTime" if timed else "None", eventTimeColumnName=order if timed else "")


class Ticks(Fold):
    """The change of a price over the one before, as a share of it."""

    def __init__(self, price: str):
        self.needs, self.gives = [price], "momentum double"

    def step(self, state: dict, price) -> tuple:
        before, state["last"] = state.get("last"), float(price)
        return (0.0 if before is None else (float(price) - before) / before,)


class Shocks(Fold):
    """A level to which impacts are added and which decays in between; a row before the latest adds without decay."""

    def __init__(self, impact: str, seconds: str, tau_hours: float):
        self.needs, self.gives, self.tau = [impact, seconds], "level double", tau_hours

    def step(self, state: dict, impact, seconds) -> tuple:
        at = state.get("at")
        level = state.get("level", 0.0) * (math.exp(-max(0.0, seconds - at) / 3600.0 / self.tau) if at is not None else 1.0)
        state["level"], state["at"] = level + float(impact), seconds if at is None else max(at, seconds)
        return (state["level"],)


class Moments(Fold):
    """Exponentially weighted mean and covariance of a series' vectors, from the first on, as `running_moments` has them."""

    def __init__(self, vector: str, decay: float = 0.95):
        self.needs, self.gives, self.decay = [vector], "mean array<double>, cov array<double>", decay

    def step(self, state: dict, vector) -> tuple:
        x = np.asarray(vector, float)
        m = np.array(state["mean"]) if "mean" in state else x
        m = self.decay * m + (1.0 - self.decay) * x
        cov = np.array(state["cov"]) if "cov" in state else np.zeros(len(x) ** 2)
        cov = self.decay * cov + (1.0 - self.decay) * np.outer(x - m, x - m).ravel()
        state["mean"], state["cov"] = m.tolist(), cov.tolist()
        return state["mean"], state["cov"]


class Spectra(Fold):
    """Bootstrapped spectra of a series' last rows at several widths, worked out anew every `every` rows: for each width and
    mode its frequency, damping, amplitude, stability (share of replicates that have it) and variance, in one array, NaN
    for modes that are not there. Replicates draw pairs of rows with repeats, by a generator that the row's number seeds."""

    FIELDS = 5

    def __init__(self, vector: str, widths: tuple[int, ...] = (20, 40, 60), every: int = 5, draws: int = 20, modes: int = 5, degree: int = 2, seed: int = 0):
        self.needs, self.gives = [vector], "spectra array<double>"
        self.widths, self.every, self.draws, self.modes, self.degree, self.seed = widths, every, draws, modes, degree, seed

    def fresh(self) -> dict:
        return {"rows": [], "n": 0, "last": None}

    def step(self, state: dict, vector) -> tuple:
        state["n"] += 1
        state["rows"] = [*state["rows"], [float(x) for x in vector]][-max(self.widths) :]
        if self.due(state["n"]):
            products = self.products(np.array(state["rows"]))
            state["last"] = self.spectra(np.array([self.sums(products, w, state["n"]) for w in self.widths])).ravel().tolist()
        return (state["last"],)

    def due(self, n: int) -> bool:
        """Whether a series' n-th row is worked out: the third, as the first that can be, and each `every`-th from there on."""
        return max(self.widths) >= 3 and (n == 3 or (n > 3 and n % self.every == 0))

    def basis(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1)), x]
        if self.degree > 1:
            i, j = np.triu_indices(x.shape[1])
            parts.append(x[:, i] * x[:, j])
        return np.concatenate(parts, 1)

    def products(self, rows: np.ndarray) -> np.ndarray:
        """For each pair of rows that follow each other the basis of the first times itself and times that of the second."""
        psi = self.basis(rows)
        return np.concatenate([psi[:-1, :, None] * psi[:-1, None, :], psi[:-1, :, None] * psi[1:, None, :]], axis=2)

    def sums(self, products: np.ndarray, width: int, n: int) -> np.ndarray:
        """The last `width` rows' products, summed as they are and by each replicate's draws; n is the last row's number."""
        pairs = products[max(len(products) + 1 - width, 0) :]
        return (_draws(self.seed, n, len(pairs) + 1, self.draws) @ pairs.reshape(len(pairs), -1)).reshape(self.draws + 1, *products.shape[1:])

    def values(self, sums: np.ndarray) -> np.ndarray:
        """Eigenvalues of the least-squares steps of many sums, the largest first. The basis begins with a one, which a step
        keeps: where the sums can be inverted, that value is one, and the others are of the rest alone."""
        m = sums.shape[-2]
        flat = sums.reshape(-1, m, 2 * m)
        own, cross = flat[:, :, :m], flat[:, :, m:]
        e = np.ones((len(flat), m), dtype=complex)
        whole = np.linalg.det(own) != 0
        inverse, size = np.linalg.inv(own[whole]), lambda z: np.sqrt((z * z).sum((1, 2)))
        sound = size(own[whole]) * size(inverse) < 1e9  # well beyond what a pseudoinverse would leave out
        whole[whole] = sound
        e[whole, 1:] = np.linalg.eigvals((inverse[sound] @ cross[whole])[:, 1:, 1:])
        e[~whole] = np.linalg.eigvals(np.linalg.pinv(own[~whole], rcond=1e-10) @ cross[~whole])
        e = np.take_along_axis(e, np.lexsort((e.imag, e.real, -np.round(np.abs(e), 12)), axis=-1), axis=-1)
        return e[:, : self.modes].reshape(*sums.shape[:-2], -1)

    def spectra(self, sums: np.ndarray) -> np.ndarray:
        """(windows, modes, FIELDS) of the sums of windows."""
        every = self.values(sums)
        base, n_modes = every[:, 0], every.shape[2]
        freq = np.abs(base.imag)
        drawn = np.empty((len(every), self.draws, n_modes))
        order = np.broadcast_to(np.argsort(freq, axis=1, kind="stable")[:, None, :], drawn.shape)
        np.put_along_axis(drawn, order, np.sort(np.abs(every[:, 1:].imag), axis=2), axis=2)  # on a line, pairs in order of size are nearest in sum
        hits = np.abs(drawn - freq[:, None]) <= 0.2 * np.maximum(freq, 0.1)[:, None]
        n = hits.sum(1)
        ranked = np.sort(np.concatenate([np.where(hits, drawn, np.inf), np.full((len(every), 1, n_modes), np.inf)], axis=1), axis=1)
        at = lambda i: np.take_along_axis(ranked, i[:, None, :], axis=1)[:, 0]
        middle = np.where(n > 0, (at(np.maximum(n - 1, 0) // 2) + at(n // 2)) / 2, freq)
        mean = np.where(hits, drawn, 0.0).sum(1) / np.maximum(n, 1)
        variance = np.where(n > 0, (np.where(hits, drawn - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(n, 1), np.inf)
        out = np.full((len(every), self.modes, self.FIELDS), np.nan)
        for i, x in enumerate((middle, -base.real, np.abs(base), n / max(self.draws, 1), variance)):
            out[:, :n_modes, i] = x
        return out


@functools.lru_cache(maxsize=1024)
def _draws(seed: int, n: int, rows: int, draws: int) -> np.ndarray:
    """Weights of the pairs of so many rows: ones, and how often each replicate draws a pair. Series share those of a number."""
    rng = np.random.default_rng([seed, n, rows])
    pairs = rows - 1
    return np.concatenate([np.ones((1, pairs)), rng.multinomial(pairs, np.full(pairs, 1.0 / pairs), size=draws).astype(float)])


def lock_vector(spectra: Column, first: int, second: int, modes: int = 5, sigma: float = 0.05, most: int = 15, stable: float = 0.6, steady: float = 0.05) -> Column:
    """Lock exp(-dissonance / sigma) of the first `most` pairs of stable and steady modes of two widths, with zeros after."""
    def of(width: int) -> Column:
        mode = lambda k: F.struct(*[F.get(spectra, (width * modes + k) * Spectra.FIELDS + i).alias(n) for i, n in ((0, "f"), (3, "s"), (4, "v"))])
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(modes - 1)), mode), lambda m: (m["s"] >= stable) & (m["v"] < steady) & ~F.isnan(m["f"]))

    pairs = F.flatten(F.transform(of(first), lambda a: F.transform(of(second), lambda b: F.exp(-spectral.dissonance(a["f"], b["f"], 10) / sigma))))
    return F.slice(F.concat(pairs, F.array_repeat(F.lit(0.0), most)), 1, most)


class Regimes(Fold):
    """Regimes that persist: the first starts after `enter` vectors, a regime ends after `leave` vectors in a row that are
    not nearer than `far` (in cosine distance) to its centroid, and a new one nearer than `merge` (in cosine) to a known
    one takes up its id. Centroids move by `rate`. The energy's mean and deviation are kept by Welford's update, afresh for
    each regime from the vectors that began it. Gives -1 before the first regime; `event` is enter, switch or empty."""

    def __init__(self, vector: str, energy: str, enter: int = 5, leave: int = 3, far: float = 0.3, merge: float = 0.85, rate: float = 0.1):
        self.needs = [vector, energy]
        self.gives = "regime int, event string, confidence double, energy_mean double, energy_std double, magnitude double"
        self.enter, self.leave, self.far, self.merge, self.rate = enter, leave, far, merge, rate

    def fresh(self) -> dict:
        return {"current": -1, "away": 0, "known": [], "buffer": [], "energies": [], "n": 0, "count": 0, "mean": 0.0, "m2": 0.0, "told": [0.0, 0.0]}

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        n = math.sqrt(v @ v)
        return v / n if n >= 1e-15 else np.zeros_like(v)

    @staticmethod
    def welford(s: dict, x: float) -> None:
        s["count"] += 1
        d = x - s["mean"]
        s["mean"] += d / s["count"]
        s["m2"] += d * (x - s["mean"])

    def promote(self, s: dict) -> float:
        """The buffered vectors become the current regime; how far it is from the one before."""
        old = np.array(s["known"][s["current"]]) if s["current"] >= 0 else None
        centre = self.unit(np.mean(s["buffer"], axis=0))
        same = next((i for i, k in enumerate(s["known"]) if float(np.array(k) @ centre) > self.merge), None)
        if same is None:
            s["known"].append([])
            same = len(s["known"]) - 1
        s["known"][same] = centre.tolist()
        s["current"], s["away"], s["n"] = same, 0, len(s["buffer"])
        s["count"], s["mean"], s["m2"], s["told"] = 0, 0.0, 0.0, [float(np.mean(s["energies"])), 0.0]
        for e in s["energies"]:
            self.welford(s, e)
        s["buffer"], s["energies"] = [], []
        return 0.0 if old is None else float(1.0 - old @ centre)

    def step(self, s: dict, vector, energy) -> tuple:
        if vector is None:
            return s["current"], "", min(1.0, s["n"] / self.enter) if s["current"] >= 0 else 0.0, *s["told"], 0.0
        x, energy, event, magnitude = self.unit(np.asarray(vector, float)), float(energy), "", 0.0
        centre = np.array(s["known"][s["current"]]) if s["current"] >= 0 else None
        if centre is not None and 1.0 - float(x @ centre) < self.far:
            s["away"], s["n"], s["buffer"], s["energies"] = 0, s["n"] + 1, [], []
            s["known"][s["current"]] = self.unit((1 - self.rate) * centre + self.rate * x).tolist()
            self.welford(s, energy)
            s["told"] = [s["mean"], math.sqrt(s["m2"] / (s["count"] - 1)) if s["count"] > 1 else 0.0]
        else:
            s["buffer"].append(x.tolist())
            s["energies"].append(energy)
            s["away"] += centre is not None
            if len(s["buffer"]) >= self.enter if centre is None else s["away"] >= self.leave:
                event = "enter" if centre is None else "switch"
                magnitude = self.promote(s)
        return s["current"], event, min(1.0, s["n"] / self.enter) if s["current"] >= 0 else 0.0, *s["told"], magnitude


CHARACTERS = ["mean_rev", "breakout", "momentum", "anticipatory"]


class BackboneFilter(Fold):
    """Extended Kalman filter of (alpha, beta, delta) from frequencies on the backbone sqrt(alpha + 3/4 beta a^2) at
    amplitude a. While the amplitude moves by less than `gate` beta cannot be told and is held. Soft classes by softmax of
    twice (alpha / |beta|, |beta|, 1 - delta, drive). Rows without a frequency, or where `active` is false, change nothing."""

    def __init__(self, frequency: str, amplitude: str, active: str, drift: float = 0.01, noise: float = 0.1, gate: float = 0.01, drive: float = 0.0):
        self.needs = [frequency, amplitude, active]
        self.gives = "alpha double, beta double, delta double, alpha_var double, beta_var double, chances array<double>, character string"
        self.drift, self.noise, self.gate, self.drive = drift, noise, gate, drive

    def fresh(self) -> dict:
        return {"theta": [1.0, 0.1, 0.1], "cov": np.eye(3).ravel().tolist(), "amplitude": None}

    def step(self, s: dict, frequency, amplitude, active) -> tuple:
        if active and frequency is not None and amplitude is not None and not (math.isnan(frequency) or math.isnan(amplitude)):
            self.update(s, float(frequency), float(amplitude))
        a, b, d = s["theta"]
        logits = [2.0 * x for x in (a / max(abs(b), 1e-6), abs(b), max(0.0, 1.0 - d), self.drive)]
        p = [math.exp(x - max(logits)) for x in logits]
        p = [x / sum(p) for x in p]
        return a, b, d, s["cov"][0], s["cov"][4], p, CHARACTERS[p.index(max(p))]

    def update(self, s: dict, frequency: float, amplitude: float) -> None:
        """In plain numbers, as arrays of three cost more than their sums; the frequency does not depend on delta."""
        a, b, d = s["theta"]
        cov = [s["cov"][0:3], s["cov"][3:6], s["cov"][6:9]]
        for i in range(3):
            cov[i][i] += self.drift
        w = math.sqrt(max(a + 0.75 * b * amplitude**2, 1e-10))
        h, k = 1.0 / (2.0 * w), 3.0 * amplitude**2 / (8.0 * w)
        g = [row[0] * h + row[1] * k for row in cov]
        total = max(h * g[0] + k * g[1] + self.noise, 1e-15)
        g = [x / total for x in g]
        if s["amplitude"] is not None and abs(amplitude - s["amplitude"]) < self.gate:
            g[1] = 0.0
        ahead = [h * x + k * y for x, y in zip(cov[0], cov[1], strict=True)]
        left = [[x - gi * y for x, y in zip(row, ahead, strict=True)] for row, gi in zip(cov, g, strict=True)]  # (1 - g h) cov
        across = [row[0] * h + row[1] * k for row in left]
        s["cov"] = [left[i][j] - across[i] * g[j] + self.noise * g[i] * g[j] for i in range(3) for j in range(3)]  # sound for any gain
        off = frequency - w
        s["theta"], s["amplitude"] = [a + g[0] * off, b + g[1] * off, d + g[2] * off], amplitude


class ProfitWindows(Fold):
    """Returns since the last event, counted from the row after it: their number, sum, variance, largest drawdown and, from
    `least` of them on, Sharpe ratio. Before the first event there is no window, and the number is null."""

    def __init__(self, ret: str, event: str, least: int = 20):
        self.needs, self.least = [ret, event], least
        self.gives = "window int, returns int, cumulative double, variance double, drawdown double, sharpe double"

    def fresh(self) -> dict:
        return {"window": 0, "n": 0, "sum": 0.0, "mean": 0.0, "m2": 0.0, "peak": 0.0, "drawdown": 0.0}

    def step(self, s: dict, ret, event) -> tuple:
        if s["window"] and ret is not None and not math.isnan(ret):
            s["n"] += 1
            s["sum"] += ret
            d = ret - s["mean"]
            s["mean"] += d / s["n"]
            s["m2"] += d * (ret - s["mean"])
            s["peak"] = max(s["peak"], s["sum"])
            s["drawdown"] = max(s["drawdown"], s["peak"] - s["sum"])
        variance = s["m2"] / (s["n"] - 1) if s["n"] > 1 else 0.0
        sharpe = s["mean"] / math.sqrt(max(variance, 1e-15)) if s["n"] >= self.least else 0.0
        told = (s["window"], s["n"], s["sum"], variance, s["drawdown"], sharpe) if s["window"] else (None,) * 6
        if event:
            s.update(self.fresh(), window=s["window"] + 1)
        return told


def reharmonize(df: DataFrame, key: str, order: str, vector: str, ret: str, idle: float | None = None, widths: tuple[int, int, int] = (20, 40, 60), modes: int = 5, draws: int = 20, sigma: float = 0.05) -> DataFrame:
    """The chained tracker, on a table or a stream: spectra at three widths, lock vectors of the first two (or the last two
    where these have none), regimes that persist, the parameter filter on the leading stable mode while there is a regime,
    and profit windows from one switch of regimes to the next. A row each, with every stage's columns. A table is dealt and
    read once, and the spectra of many rows are worked out together (`tracker.track`); a stream chains its folds."""
    if not df.isStreaming:
        from tidegauge.streaming.tracker import track

        return track(df, key, order, vector, ret, idle, Spectra(vector, widths, draws=draws, modes=modes), sigma)
    return chained(df, key, order, vector, ret, idle, widths, modes, draws, sigma)


def chained(df: DataFrame, key: str, order: str, vector: str, ret: str, idle: float | None, widths: tuple[int, int, int], modes: int, draws: int, sigma: float) -> DataFrame:
    """`reharmonize` by one fold after the other."""
    rows = fold(df.select(key, order, vector, ret), key, order, Spectra(vector, widths, draws=draws, modes=modes), idle).drop(vector)
    size = F.col("spectra").isNotNull()
    near, far = lock_vector(F.col("spectra"), 0, 1, modes, sigma), lock_vector(F.col("spectra"), 1, 2, modes, sigma)
    rows = rows.withColumn("locks", F.when(size, F.when(F.exists(near, lambda x: x > 0), near).otherwise(far)))
    some = F.filter("locks", lambda x: x > 0)
    rows = rows.withColumn("coherence", F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some)).otherwise(0.0))
    own = F.transform(F.sequence(F.lit(0), F.lit(modes - 1)), lambda k: F.struct(*[F.get("spectra", k * Spectra.FIELDS + i).alias(n) for i, n in ((0, "f"), (2, "a"), (3, "s"))]))
    lead = F.get(F.filter(own, lambda m: (m["s"] >= 0.6) & ~F.isnan(m["f"])), F.lit(0))
    rows = rows.withColumn("frequency", lead["f"]).withColumn("amplitude", lead["a"]).drop("spectra")
    rows = fold(rows, key, order, Regimes("locks", "coherence"), idle).drop("locks").withColumn("settled", F.col("regime") >= 0).withColumn("switched", F.col("event") == "switch")
    rows = fold(rows, key, order, BackboneFilter("frequency", "amplitude", "settled"), idle).drop("settled")
    return fold(rows, key, order, ProfitWindows(ret, "switched"), idle).drop("switched")
