"""Fits with Spark ML: projections, subspaces, clusters, retraining; text profiles and observers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import market
from tidegauge.operators import statistics as st
from tidegauge.operators.store import written


def _literal(v: list[float]) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in v])


def pca_project(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Adds `projected`: the k leading coordinates, each direction with its largest part positive."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(0), np.arange(k)])
    return model.transform(rows).withColumn("projected", F.zip_with(vector_to_array("_p"), _literal(signs.tolist()), lambda a, s: a * s)).drop("_v", "_p")


def fit_subspaces(df: DataFrame, vector: str, label: str, k: int) -> dict:
    """For each label the k leading right singular directions of its vectors, as rows."""
    out = {}
    for r in df.select(label).distinct().collect():
        rows = df.where(F.col(label) == r[0]).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
        out[r[0]] = PCA(k=k, inputCol="v", outputCol="p").fit(rows).pc.toArray().T.tolist()
    return out


def project_validity(df: DataFrame, vector: str, first: list[list[float]], second: list[list[float]]) -> DataFrame:
    """Adds `validity`: the norm of a vector's projection onto one subspace less that onto another."""
    size = lambda basis: F.sqrt(sum((F.pow(market.dot(F.col(vector), _literal(b)), 2) for b in basis), F.lit(0.0)))
    return df.withColumn("validity", size(first) - size(second))


def cluster_graph(edges: DataFrame, k: int, weight: str = "weight", rounds: int = 20) -> DataFrame:
    """(id, cluster) of a graph's nodes by power iteration over absolute weights."""
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.abs(F.col(weight)).alias("w")).where("w > 0 and src < dst")
    return PowerIterationClustering(k=k, maxIter=rounds, weightCol="w").assignClusters(e)


def retrain(logs: list[DataFrame], features: list[str], energy: str, label: str, least_auc: float = 0.85, least_rows: int = 10, folds: int = 5, seed: int = 0):
    """(model or None, AUC): a logistic model on standardised features and energy, kept if its cross-validated AUC is high
    enough."""
    rows = logs[0]
    for more in logs[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(array_to_vector(F.array(*features, energy).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        if rows.count() < least_rows or rows.select("y").distinct().count() < 2:
            return None, 0.0
        steps = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="y")])
        found = CrossValidator(estimator=steps, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=folds, seed=seed).fit(rows)
        auc = float(found.avgMetrics[0])
        return (found.bestModel if auc >= least_auc else None), auc
    finally:
        rows.unpersist()


def observer_state(df: DataFrame, entity: str, order: str, vector: str, most: int = 50, least: int = 5, gamma: float = 0.1, least_trust: float = 0.3) -> DataFrame:
    """An EDMD of each entity's last vectors, with its trust min(1, gap / gamma); entities with too few or untrusted ones
    are left out."""
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order)))).withColumn("_n", F.count("*").over(Window.partitionBy(entity))).where((F.col("_r") <= most) & (F.col("_n") >= least))
    fit = st.edmd_fit(last, entity, order, vector, degree=0).withColumn("trust", F.least(F.lit(1.0), F.col("gap") / gamma))
    return fit.where(F.col("trust") >= least_trust)


def section_profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, weight, and the densities) of each paragraph over 20 characters; weights sum to 1 in a document."""
    from tidegauge.functions.text import densities

    parts = docs.select(key, F.posexplode(F.filter(F.transform(F.split(text, r"\n\s*\n|\n#+\s"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)).alias("section", "_s"))
    scored = parts.select(key, "section", *[c.alias(k) for k, c in densities(F.col("_s")).items()])
    raw = F.col("technical") + F.col("citation") + 0.01
    return scored.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(key)))


def overlap_heatmap(library: DataFrame, dims: DataFrame, key: str, types: list[str] | None = None) -> DataFrame:
    """Active places by domain and equation type. library: (key, domains, type); dims: (key, dims), different
    places, one row for each key. The types are columns; if they are named, the table need not be read for them."""
    n = dims.select(key, F.size("dims").cast("long").alias("_n"))
    return library.join(n, key).select(F.explode("domains").alias("domain"), "type", "_n").groupBy("domain").pivot("type", types).agg(F.sum("_n")).na.fill(0)


def spectral_robustness(df: DataFrame, series: str, order: str, vector: str, folds: int = 4, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """How steady a series' leading eigenvalue is over its folds: (series, drift, gap, robustness)."""
    rows = df.withColumn("_k", F.concat_ws(":", F.col(series).cast("string"), F.ntile(folds).over(Window.partitionBy(series).orderBy(order)).cast("string")))
    fit = st.edmd_fit(rows, "_k", order, vector, degree=1).select(F.split("_k", ":")[0].alias(series), F.split("_k", ":")[1].cast("int").alias("_f"), F.hypot(F.col("re")[0], F.col("im")[0]).alias("_lead"), "gap", "error")
    step = F.abs(F.col("_lead") - F.lag("_lead").over(Window.partitionBy(series).orderBy("_f")))
    a, b, c = weights
    out = fit.withColumn("_d", step).groupBy(series).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("drift"), F.avg("gap").alias("gap"), F.avg("error").alias("_e"))
    return out.withColumn("robustness", a / (1 + F.col("drift")) + b * F.tanh("gap") + c * F.exp(-F.col("_e"))).drop("_e")


def score_batches(df: DataFrame, columns: list[str], score: Callable[[np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    """Adds what `score` gives for rows of numbers (rows by `columns`), called once a batch; null numbers come as NaN."""

    def scored(frames):
        for pdf in frames:
            yield pd.Series(np.asarray(score(pdf[columns].to_numpy(dtype=float)), dtype=float))

    scored.__annotations__ = {"frames": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(scored, "double")(F.struct(*columns)))


def fiber_resonance(profiles: DataFrame, domain: str) -> DataFrame:
    """(a, b, similarity) of domains' eigenvalue ratios. profiles: (domain, eigenvalues)."""
    ratios = F.transform("eigenvalues", lambda e: F.when(F.col("eigenvalues")[0] > 0, e / F.col("eigenvalues")[0]).otherwise(0.0))
    p = profiles.select(F.col(domain).alias("d"), ratios.alias("r"))
    pairs = p.alias("x").join(p.alias("y"), F.col("x.d") < F.col("y.d"))
    return pairs.select(F.col("x.d").alias("a"), F.col("y.d").alias("b"), market.cosine(F.col("x.r"), F.col("y.r")).alias("similarity"))


def shared_directions(df: DataFrame, domain: str, vector: str, k: int, least: float = 0.5) -> DataFrame:
    """(direction, strength, least_norm, v): directions that lie in the subspaces of all domains, where a domain's subspace
    is spanned by its k leading eigenvectors of sums of products. Directions are eigenvectors of the sum of the domains'
    projectors, the strongest first, with their largest part positive; those stay whose projection onto every domain's
    subspace has at least the norm `least`. Only one small matrix a domain is solved, and one for all."""
    kind = df.schema[domain].dataType.simpleString()

    def project(frames):
        for pdf in frames:
            out = []
            for name, p in zip(pdf[domain], pdf["products"], strict=True):
                d = int(round(len(p) ** 0.5))
                e, v = np.linalg.eigh(np.asarray(p).reshape(d, d))
                basis = v[:, ::-1][:, : min(k, int((e > 1e-12 * max(e[-1], 1e-300)).sum()))]
                out.append((name, (basis @ basis.T).ravel().tolist()))
            yield pd.DataFrame(out, columns=[domain, "projector"])

    projectors = written(st.gram(df.where(F.col(domain).isNotNull()), [domain], vector).select(domain, "products").mapInPandas(project, f"{domain} {kind}, projector array<double>"), "projectors")
    cells = projectors.select(F.posexplode("projector").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    whole = cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda a: a["x"]).alias("total")).join(F.broadcast(projectors.agg(F.count("*").alias("n"))), F.lit(True))  # one row each

    def solve(frames):
        for pdf in frames:
            for total, n in zip(pdf["total"], pdf["n"], strict=True):
                d = int(round(len(total) ** 0.5))
                if not d or n < 2:
                    continue
                e, v = np.linalg.eigh(np.asarray(total).reshape(d, d))
                order = np.argsort(-e, kind="stable")
                v = v[:, order] * np.sign(v[np.abs(v).argmax(0), np.arange(d)])[order]
                yield pd.DataFrame({"direction": range(1, d + 1), "strength": e[order] / n, "v": list(v.T.tolist())})

    found = whole.where("size(total) > 0").mapInPandas(solve, "direction int, strength double, v array<double>")
    size = F.size("v")
    norm = F.aggregate(F.transform("projector", lambda p, i: p * F.get("v", F.floor(i / size).cast("int")) * F.get("v", (i % size).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    met = projectors.join(F.broadcast(found), F.lit(True)).withColumn("norm", F.sqrt(F.greatest(norm, F.lit(0.0))))  # as many directions as parts
    told = met.groupBy("direction").agg(F.first("strength").alias("strength"), F.min("norm").alias("least_norm"), F.first("v").alias("v"))
    return told.where(F.col("least_norm") >= least)
