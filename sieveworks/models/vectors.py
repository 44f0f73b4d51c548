"""Vector classifiers: nearest centroid and linear softmax.

Centroids are per-(label, dimension) averages — a hash aggregate with
partial aggregation, so a dominant label is pre-summed map-side.  Scoring
compares every vector with every centroid: the centroid table (labels ×
dimensions) is size-checked, then broadcast to numpy scorers in Arrow
batches; above the bound it goes out in slices whose partial results merge
exactly (log-sum-exp).  No cross join is planned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INLINE_VALUES = 2_000_000  # labels × dimensions broadcast at once
MAX_CENTROID_VALUES = 10_000_000  # labels × dimensions that the driver holds
MAX_CLASSES = 10_000  # of a linear classifier: its weights are held by the driver


def vector_check(df: DataFrame, label: str) -> DataFrame:
    """≥4 samples, ≥2 classes, ≥2 per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    agg = per.agg(F.sum("n").cast("long").alias("samples"), F.count(F.lit(1)).alias("classes"),
                  F.min("n").alias("smallest_class"))
    ok = (F.col("samples") >= 4) & (F.col("classes") >= 2) & (F.col("smallest_class") >= 2)
    return agg.select("samples", "classes", "smallest_class", ok.alias("ok"))


def centroid_fit(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, dim, value)``: the mean vector of each class, long format."""
    return (df.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
            .groupBy("label", "dim").agg(F.avg("x").alias("value")))


def centroids_as_arrays(long: DataFrame) -> list[tuple[object, list[float]]]:
    """Collect the (bounded, size-checked) centroid table to the driver."""
    n = long.count()
    if n > MAX_CENTROID_VALUES:
        raise ValueError(f"more than {MAX_CENTROID_VALUES} centroid values; reduce labels or dimensions")
    rows = long.collect()
    by: dict[object, dict[int, float]] = {}
    for r in rows:
        by.setdefault(r["label"], {})[int(r["dim"])] = float(r["value"])
    out = []
    for lab in sorted(by, key=lambda v: str(v)):
        dims = by[lab]
        out.append((lab, [dims[i] for i in range(len(dims))]))
    return out


def _slices(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)] or [[]]


def softmax_top_k(scores: Column, k: int) -> Column:
    """Softmax over ``s`` then the ``k`` best ``{label, score}``."""
    from ..plans.ordering import top_k_ranked

    m = F.array_max(F.transform(scores, lambda e: e["s"]))
    ex = F.transform(scores, lambda e: F.struct(e["label"].alias("label"), F.exp(e["s"] - m).alias("e")))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, e: acc + e["e"])
    items = F.transform(ex, lambda e: F.struct(e["label"].alias("label"), (e["e"] / total).alias("score")))
    return top_k_ranked(items, k)


PREDICTIONS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                         T.StructField("score", T.DoubleType())]))


def _numpy_scorer(shared, vector: str, top_k: int):
    def run(batches):
        labels, cents = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(predictions=[])
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            s = np.empty((len(x), len(labels)))
            for j in range(len(labels)):
                s[:, j] = -np.mean((cents[j] - x) ** 2, axis=1)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")[:, :top_k]
            preds = [[{"label": labels[j], "score": float(p[i, j])} for j in order[i]] for i in range(len(x))]
            yield pdf.assign(predictions=preds)
    return run


def _numpy_partial(shared, vector: str, top_k: int, best: str, log_sum: str):
    """Scores of one slice of the centroids: its best ``top_k`` and the
    logarithm of the sum of all its exponentials."""
    def run(batches):
        labels, cents = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            s = np.empty((len(x), len(labels)))
            for j in range(len(labels)):
                s[:, j] = -np.mean((cents[j] - x) ** 2, axis=1)
            m = s.max(axis=1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
            rows = [[{"label": labels[j], "score": float(s[i, j])} for j in order[i]] for i in range(len(x))]
            yield pdf.assign(**{best: rows, log_sum: m + np.log(np.exp(s - m[:, None]).sum(axis=1))})
    return run


def centroid_classify(df: DataFrame, vector: str, centroids: list[tuple[object, list[float]]],
                      top_k: int = 3) -> DataFrame:
    """Adds ``predictions`` (top-k ``{label, score}``, softmax of
    ``-mean((c − x)²)``).

    Within the inline bound the centroid matrix is broadcast once and each
    task scores its vectors with numpy in Arrow batches.  Larger tables are
    broadcast and scored slice by slice: each slice keeps its own top-k and
    log-sum-exp, which merge exactly into the global softmax."""
    dim = len(centroids[0][1]) if centroids else 0
    if len(centroids) * max(dim, 1) <= MAX_INLINE_VALUES:
        spark = df.sparkSession
        labels = [str(lab) for lab, _ in centroids]
        shared = spark.sparkContext.broadcast((labels, np.array([c for _, c in centroids], dtype=np.float64)))
        schema = T.StructType(df.schema.fields + [T.StructField("predictions", PREDICTIONS)])
        return df.mapInPandas(_numpy_scorer(shared, vector, top_k), schema)
    out, n = df, 0
    for n, part in enumerate(_slices(centroids, max(1, MAX_INLINE_VALUES // max(dim, 1))), 1):
        shared = df.sparkSession.sparkContext.broadcast(
            ([str(lab) for lab, _ in part], np.array([c for _, c in part], dtype=np.float64)))
        schema = T.StructType([*out.schema.fields, T.StructField(f"__sw_b{n}", PREDICTIONS),
                               T.StructField(f"__sw_l{n}", T.DoubleType())])
        out = out.mapInPandas(_numpy_partial(shared, vector, top_k, f"__sw_b{n}", f"__sw_l{n}"), schema)
    sums = F.array(*[F.col(f"__sw_l{i}") for i in range(1, n + 1)])
    most = F.array_max(sums)
    log_total = most + F.log(F.aggregate(sums, F.lit(0.0), lambda acc, v: acc + F.exp(v - most)))
    best = F.flatten(F.array(*[F.col(f"__sw_b{i}") for i in range(1, n + 1)]))
    from ..plans.ordering import top_k_ranked

    items = F.transform(best, lambda e: F.struct(e["label"].alias("label"), F.exp(e["score"] - log_total).alias("score")))
    out = out.withColumn("predictions", top_k_ranked(items, top_k))
    return out.drop(*[f"__sw_{x}{i}" for i in range(1, n + 1) for x in "bl"])


def linear_softmax_fit(df: DataFrame, vector: str, label: str, max_iter: int = 1000, c: float = 1.0):
    """Multinomial logistic regression with MLlib (distributed L-BFGS).

    Labels of any type are numbered in their text order; rows without a label
    or vector are left out.  ``c`` is the inverse strength of the L2 penalty
    on the summed loss, with features as they are; ``c=0`` means none."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    named = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("name"))
    named = named.filter("v IS NOT NULL AND name IS NOT NULL")
    counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes.")
    labels = sorted((r["name"] for r in counts), key=_label_order)
    total = sum(r["n"] for r in counts)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("name")) - 1
    data = named.select(array_to_vector(F.col("v")).alias("features"), place.cast("double").alias("label"))
    model = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * total) if c else 0.0, standardization=False,
                               family="multinomial").fit(data)
    return labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def linear_softmax_gradient(df: DataFrame, vector: str, label: str, labels: list[str], weights: np.ndarray,
                            intercept: np.ndarray, c: float = 1.0) -> np.ndarray:
    """(classes, 1 + dimensions) gradient of the penalised mean loss at given
    weights, intercepts first: all zero at the optimum, whoever found it."""
    from .tabular import StoredBlocks, _gradients

    k, d = len(labels), weights.shape[1] + 1
    both = np.concatenate([intercept[:, None], weights], axis=1).T
    if both.shape[1] == 1 and k == 2:
        both = np.concatenate([-both, both], axis=1)
    v = F.col(vector).cast("array<double>")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")) - 1
    encoded = (df.select(F.concat(F.array(F.lit(1.0)), v).alias("x"), place.cast("double").alias("y"),
                         F.lit(True).alias("fit")).filter("x IS NOT NULL AND y IS NOT NULL"))
    with StoredBlocks(encoded, d) as blocks:
        got = blocks.total(d * k + 2, _gradients([both], k))
    n = got[-1]
    gradient = got[:d * k].reshape(d, k) / n
    if c:
        gradient[1:] += both[1:] / (c * n)
    return gradient.T


def _label_order(text: str):
    """Numbers by value, then texts."""
    return (0, int(text), "") if text.lstrip("-").isdigit() else (1, 0, text)


def linear_scores(x: Column, labels: list[str], weights: np.ndarray, intercept: np.ndarray) -> Column:
    """``x·Wᵀ + b`` per label; a single binary row expands to (−d, d)."""
    rows = []
    for j in range(weights.shape[0]):
        w = F.array(*[F.lit(float(v)) for v in weights[j]])
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        rows.append(dot + F.lit(float(intercept[j])))
    if len(rows) == 1 and len(labels) == 2:
        rows = [-rows[0], rows[0]]
    return F.array(*[F.struct(F.lit(lab).alias("label"), r.alias("s")) for lab, r in zip(labels, rows)])
