"""Hashed embeddings of texts and what is made of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import market

#: Positions whose hashes a worker keeps, 2 bytes (4 from 16,384 places on) for each of 256 bytes, of which only those that
#: a text has are ever taken up; those beyond are hashed again for each text.
KEPT = 1 << 17
_TABLES: dict[int, np.ndarray] = {}


def _place(dim: int, byte: int, position: int) -> int:
    """Place and sign of a byte's hash at a position: 1 + place, below zero for a minus."""
    h = int.from_bytes(hashlib.md5(b"%d_%d" % (byte, position)).digest()) % (2 * dim)
    return h + 1 if h < dim else dim - h - 1


def _places(dim: int, data: np.ndarray) -> np.ndarray:
    if dim not in _TABLES:
        _TABLES[dim] = np.zeros((KEPT, 256), np.int16 if dim < 1 << 14 else np.int32)
    table = _TABLES[dim]
    near = np.arange(min(len(data), KEPT))
    new = near[table[near, data[:KEPT]] == 0]
    table[new, data[new]] = [_place(dim, b, p) for b, p in zip(data[new].tolist(), new.tolist(), strict=True)]
    far = [_place(dim, b, p) for p, b in enumerate(data[KEPT:].tolist(), KEPT)]
    return np.concatenate([table[near, data[:KEPT]], np.array(far, np.int32)])


def hash_embed(text: Column, dim: int = 200) -> Column:
    """Signed hashes of (byte, position) pairs of the whole text summed into `dim` places, over the sum's norm."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            code = _places(dim, np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8))
            plus, minus = code[code > 0] - 1, -1 - code[code < 0]
            v = np.bincount(plus, minlength=dim)[:dim] - np.bincount(minus, minlength=dim)[:dim].astype(float)
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).tolist())
        return pd.Series(out)

    return embed(text)


def article_vector(embedded: Column, validity: Column, bias: Column, decay: Column) -> Column:
    """An embedding times max(0.1, 0.5 + validity), less its source's bias, times its decay."""
    parts = F.struct(F.greatest(F.lit(0.1), 0.5 + validity).alias("scale"), decay.alias("decay"))
    return market.let(parts, lambda p: F.zip_with(embedded, bias, lambda x, b: (x * p["scale"] - F.coalesce(b, F.lit(0.0))) * p["decay"]))


def intent_vector(embedded: Column, profile: Column) -> Column:
    """An embedding with half of a six-part profile on its first places, over the norm."""
    return market.normalized(F.transform(embedded, lambda x, i: x + 0.5 * F.coalesce(F.get(profile, i), F.lit(0.0))))


def patch_distance(spec_a: Column, spec_b: Column, comm_a: Column, comm_b: Column, rank_a: Column, rank_b: Column, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> Column:
    """Weighted distance of two patches: of normalised spectra, of commutators, of ranks."""
    apart = market.norm(F.zip_with(market.normalized(spec_a), market.normalized(spec_b), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return alpha * apart + beta * F.abs(comm_a - comm_b) + gamma * F.abs(rank_a - rank_b) / F.greatest(rank_a, rank_b, F.lit(1))
