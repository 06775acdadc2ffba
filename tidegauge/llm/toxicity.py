"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over them, and a linear
classifier trained on the model's posterior labels.

1. Voters are mined from a bounded sample of labelled training rows: words (lexicon voters) and word beginnings of
   four to six letters (pattern voters), those whose presence speaks most for either label.
2. The label model is generative: a text's label is drawn with the prior, and each voter votes with a probability that
   depends on the label. Expectation maximisation estimates the prior and the voters' accuracies from the votes (the
   given label is one of them), and the voters' correlations within a label, by which a vote that others repeat counts
   less.
3. A logistic regression over the voters' votes and those of further words learns from the posterior labels. A text's
   score is its probability.

Null and empty texts are scored as texts without any word. Repeated rows are scored alike. Without labelled rows of
both labels every score is the share of label 1 seen (0 if none). Columns beside those named are not read; label,
language, source and id never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches

#: Most labelled rows of each label learned from (in expectation, by a hash of the id).
MOST_ROWS = 4_000
#: Most voters, most features of the classifier, and in how many texts of a label a voter is seen at least.
VOTERS, FEATURES, LEAST_TEXTS = 192, 768, 4
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def cues(text: str | None) -> set[str]:
    """The distinct lower-case words of a text, and their beginnings marked by a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


def weights_of(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, weight of each voter's vote, how much each is discounted) by expectation maximisation.
    votes: rows by voters, 0 (abstains) or 1; start: each row's given label, one more voter, right in 98 of 100."""
    q = np.clip(start.astype(float), 0.02, 0.98)
    given = np.log(q / (1 - q))
    discount = np.ones(votes.shape[1])
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        one = (q @ votes + 0.5 * prior) / (q.sum() + 1.0)
        zero = ((1 - q) @ votes + 0.5 * (1 - prior) * 0.1) / ((1 - q).sum() + 1.0)
        # correlations of voters within a label, both labels' covariances pooled
        centred = votes - (q[:, None] * one + (1 - q)[:, None] * zero)
        cov = centred.T @ centred / len(votes)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        near = np.clip(cov / scale[:, None] / scale[None], 0, 1)
        np.fill_diagonal(near, 0)
        discount = 1 / (1 + np.where(near > 0.5, near, 0).sum(1))
        vote = discount * np.log(one / zero)  # a voter that says nothing says nothing about the label
        logit = np.log(prior / (1 - prior)) + votes @ vote + given
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, vote, discount


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method; y may be probabilities. Both labels weigh alike."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = y * 0.5 / share + (1 - y) * 0.5 / (1 - share)
    x1 = np.c_[x, np.ones(len(x))]
    w, hold = np.zeros(x1.shape[1]), np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - y)) + hold @ w
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + hold, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    voters: dict[str, float]  # each voter's discounted log odds in the label model; "" is the silent one

    def score(self, text: str | None) -> float:
        known = self.weights
        z = self.intercept + sum(known[c] for c in cues(text) & known.keys())
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def train(docs: DataFrame, labels: DataFrame, trainable: Callable[[Column], Column], label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """Fits on at most about `most_rows` rows of each label, of those for whose id `trainable` holds. Several labels of
    an id: the largest counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & trainable(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, most_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most_rows / max(1, sizes.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 20)) < share * (1 << 20))
    sample = rows.join(F.broadcast(chosen), "id")  # at most about twice most_rows ids, however large the tables

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array((sorted(cues(t.as_py())) for t in b.column(0)), pa.list_(pa.string()))], ["y", "cues"])

    told = map_batches(sample.select("text", "y"), read, "y int, cues array<string>").persist()
    n = {r.y: r.n for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        told.unpersist()
        share = n1 / max(1, n0 + n1)
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), {})
    counted = told.select("y", F.explode("cues").alias("cue")).groupBy("cue").agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("zero"))
    odds = F.ln((F.col("one") + 0.1) / (n1 + 0.2)) - F.ln((F.col("zero") + 0.1) / (n0 + 0.2))
    weight = F.abs(odds) * F.sqrt((F.col("one") / n1 + F.col("zero") / n0))
    strong = counted.where(f"one >= {LEAST_TEXTS} or zero >= {LEAST_TEXTS}").select("cue", odds.alias("odds"), weight.alias("weight"))
    found = strong.orderBy(F.desc("weight"), "cue").limit(FEATURES).collect()
    voters = [r.cue for r in found if abs(r.odds) > 1][:VOTERS]
    order = list(dict.fromkeys(voters + [r.cue for r in found]))
    place = {c: i for i, c in enumerate(order)}
    named = F.array(*[F.lit(c) for c in order])
    rows_ = told.select("y", F.array_intersect("cues", named).alias("cues")).collect()
    told.unpersist()
    x, y = np.zeros((len(rows_), len(order))), np.array([r.y for r in rows_], float)
    for i, r in enumerate(rows_):
        x[i, [place[c] for c in r.cues]] = 1
    if voters:
        odds_of = {r.cue: r.odds for r in found}
        for_one = [place[c] for c in voters if odds_of[c] > 1]
        silent = (x[:, for_one].sum(1) == 0).astype(float)  # one more voter: none of those for label 1 is there
        q, vote, _ = weights_of(np.c_[x[:, : len(voters)], silent], y)
    else:
        q, vote = y, np.zeros(0)
    w, b = logistic(x, q)
    return Model({c: float(v) for c, v in zip(order, w, strict=True)}, b, dict(zip([*voters, ""], map(float, vote), strict=False)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((m.score(t.as_py()) for t in b.column(1)), pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")
