"""Tabular predictor: feature schema, encoding, ridge and softmax fits,
scoring and metrics.

Only d-sized objects reach the driver: the feature schema (bounded by
columns × maximum_categories), the d×d Gram matrix and the d×k weights.
Rows are encoded with column expressions; Gram matrices and gradients are
packed partial sums, one per partition, computed with numpy (``mapInArrow``)
and added up in a tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pysem import dtype_of, py_float, py_str

MISSING = "[MISSING]"
MAXIMUM_CLASSES = 10_000  # a weight column for each is held by the driver and every task


@dataclass
class Feature:
    name: str
    kind: str
    median: float = 0.0
    mean: float = 0.0
    scale: float = 1.0
    categories: list[str] = field(default_factory=list)


def _numeric(df: DataFrame, name: str) -> Column:
    v = py_float(F.col(name), dtype_of(df, name))
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _category(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    dtype = dtype_of(df, name)
    text = py_str(c, dtype)
    empty = c.isNull() | (c.cast("string") == "") if isinstance(dtype, T.StringType) else c.isNull()
    return F.when(empty, F.lit(MISSING)).otherwise(text)


def feature_schema(train: DataFrame, features: list[str], maximum_categories: int = 50) -> list[Feature]:
    """Numeric when at least ``max(1, int(0.9 · non-empty))`` values parse to
    finite floats: median, mean, population std (0 → 1).  Otherwise the
    ``maximum_categories`` most frequent values (ties: first seen).

    One aggregate decides the kinds, one counts the values of all categorical
    columns, and the medians of all numeric columns come from shared narrowing
    passes, so the number of jobs does not grow with the number of columns.
    The narrow feature projection is persisted (memory, spilling to disk); it
    is deterministic, so lost blocks are recomputed identically."""
    from pyspark import StorageLevel

    train = train.select(*features, "__sw_sn").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _feature_schema(train, features, maximum_categories)
    finally:
        train.unpersist()


def _feature_schema(train: DataFrame, features: list[str], maximum_categories: int) -> list[Feature]:
    from ..plans.select import order_statistics

    aggs = []
    for i, name in enumerate(features):
        dtype = dtype_of(train, name)
        c = F.col(name)
        nonempty = c.isNotNull() & (c.cast("string") != "") if isinstance(dtype, T.StringType) else c.isNotNull()
        num = _numeric(train, name)
        aggs += [F.count_if(num.isNotNull()).alias(f"f{i}"), F.count_if(nonempty).alias(f"e{i}"),
                 F.avg(num).alias(f"m{i}"), F.stddev_pop(num).alias(f"s{i}"), F.min(num).cast("double").alias(f"lo{i}"),
                 F.max(num).cast("double").alias(f"hi{i}")]
    stats = train.agg(*aggs).first()
    numeric = [i for i in range(len(features)) if stats[f"f{i}"] and
               stats[f"f{i}"] >= max(1, int(stats[f"e{i}"] * 0.9))]
    middle = {f"v{i}": [(stats[f"f{i}"] + 1) // 2, stats[f"f{i}"] // 2 + 1] for i in numeric}
    values = train.select(*[_numeric(train, features[i]).cast("double").alias(f"v{i}") for i in numeric])
    middle = order_statistics(values, middle, {f"v{i}": (stats[f"lo{i}"], stats[f"hi{i}"]) for i in numeric})
    categories = _top_categories(train, {i: n for i, n in enumerate(features) if i not in numeric}, maximum_categories)
    out: list[Feature] = []
    for i, name in enumerate(features):
        if i in numeric:
            low, high = middle[f"v{i}"]
            out.append(Feature(name, "numeric", low / 2 + high / 2 if low != high else low, float(stats[f"m{i}"]),
                               float(stats[f"s{i}"] or 0.0) or 1.0))
        else:
            out.append(Feature(name, "categorical", categories=categories[i]))
    return out


def _top_categories(train: DataFrame, names: dict[int, str], most: int) -> dict[int, list[str]]:
    """The ``most`` frequent values of each column, ties in order of
    appearance: one aggregate over the values of all columns, of which only
    the chosen ones reach the driver."""
    out: dict[int, list[str]] = {i: [] for i in names}
    if not names:
        return out
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _category(train, n).alias("v")) for i, n in names.items()]))
    counts = (train.select(each.alias("e"), "__sw_sn").groupBy("e.i", "e.v")
              .agg(F.count(F.lit(1)).alias("n"), F.min("__sw_sn").alias("first")))
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.col("n").desc(), "first"))
    for row in sorted(counts.withColumn("place", place).filter(F.col("place") <= most).collect(),
                      key=lambda r: (r["i"], r["place"])):
        out[row["i"]].append(row["v"])
    return out


def encode(df: DataFrame, schema: list[Feature]) -> Column:
    """``array<double>``: intercept 1, standardised numerics (bad → median),
    one-hot categories plus an OTHER flag."""
    parts: list[Column] = [F.lit(1.0)]
    for f in schema:
        if f.kind == "numeric":
            x = F.coalesce(_numeric(df, f.name), F.lit(f.median))
            parts.append((x - F.lit(f.mean)) / F.lit(max(f.scale, 1e-12)))
        else:
            v = _category(df, f.name)
            parts += [F.when(v == F.lit(c), 1.0).otherwise(0.0) for c in f.categories]
            parts.append(F.when(v.isin(*f.categories), 0.0).otherwise(1.0) if f.categories else F.lit(1.0))
    return F.array(*[p.cast("double") for p in parts])


BLOCK_ROWS = 8192    # encoded rows that a pass computes with at a time
BLOCK_BYTES = 8192   # of the features of a stored block: Spark sends blocks in thousands
FAN_IN = 32          # partial results that one task, or the driver, adds up


def _doubles(column: pa.Array) -> np.ndarray:
    """All numbers in a column of lists or of packed bytes, without a copy."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros(0)
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = int(at[column.offset]), int(at[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], np.float64, (last - first) // 8, first) if last > first else np.zeros(0)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Rows packed once into small matrices, so that no pass unpacks arrays."""
    step = max(1, BLOCK_BYTES // (8 * d))
    for batch in batches:
        n = batch.num_rows
        x = np.ascontiguousarray(_doubles(batch.column("x")), np.float64).reshape(n, d)
        y = batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
        fit = batch.column("fit").to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = range(0, n, step)
        yield pa.RecordBatch.from_arrays([pa.array([v[at:at + step].tobytes() for at in cuts], pa.binary())
                                          for v in (x, y, fit)], ["x", "y", "fit"])


class StoredBlocks:
    """Encoded rows ``(x, y, fit)`` stored as matrices (memory, spilling to
    disk) for passes that sum one packed array over all of them.

    Each partition gives one row with its whole partial array.  Beyond
    ``FAN_IN`` partitions the rows are added in levels of that fan-in, so a
    pass shuffles as many rows as there are partitions and the driver adds at
    most ``FAN_IN``; with fewer partitions nothing is shuffled."""

    def __init__(self, encoded: DataFrame, d: int):
        from pyspark import StorageLevel

        self.d = d
        self.rows = (encoded.select("x", "y", "fit").mapInArrow(lambda b: _blocks(b, d), "x binary, y binary, fit binary")
                     .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            self.parts = self.rows.select(F.spark_partition_id().alias("p")).distinct().count()
        except BaseException:
            self.rows.unpersist()
            raise

    def __enter__(self) -> StoredBlocks:
        return self

    def __exit__(self, *_: object) -> None:
        self.rows.unpersist()

    def total(self, size: int, partial) -> np.ndarray:
        """Sum over all blocks of ``partial(x, y, fit)``, arrays of ``size``."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                y = _doubles(batch.column("y"))
                x, fit = _doubles(batch.column("x")).reshape(len(y), d), _doubles(batch.column("fit")) > 0
                for at in range(0, len(y), BLOCK_ROWS):
                    part = slice(at, at + BLOCK_ROWS)
                    out += partial(x[part], y[part], fit[part])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        return tree_sum(self.rows.mapInArrow(run, "sums binary"), size, self.parts)


def tree_sum(partials: DataFrame, size: int, parts: int, fan_in: int = FAN_IN) -> np.ndarray:
    """Sum of the packed arrays in the one column of ``partials``, about
    ``parts`` rows, added ``fan_in`` at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size)
        for pdf in batches:
            for block in pdf.iloc[:, 0]:
                out += np.frombuffer(block)
        yield pd.DataFrame({"sums": [out.tobytes()]})

    while parts > fan_in:
        parts = -(-parts // fan_in)
        partials = partials.repartition(parts).mapInPandas(run, "sums binary")
    out = np.zeros(size)
    for row in partials.collect():
        out += np.frombuffer(row[0])
    return out


def _ridge(sums: np.ndarray, d: int, regularization: float) -> np.ndarray:
    penalty = np.eye(d) * regularization
    penalty[0, 0] = 0.0
    gram, moments = sums[:d * d].reshape(d, d) + penalty, sums[d * d:]
    inverse = np.linalg.pinv(gram)
    weights = inverse @ moments
    for _ in range(2):  # the flags of a column leave the matrix badly conditioned
        weights = weights + inverse @ (moments - gram @ weights)
    return weights


def ridge_fit(encoded: DataFrame, d: int, regularization: float = 0.001) -> np.ndarray:
    """``pinv(XᵀX + λI₀) Xᵀy`` with the intercept unpenalised.  ``encoded`` has
    ``x array<double>`` and ``y double``; the d×d system is solved on the
    driver."""
    return ridge_fit_with_validation(encoded.withColumn("split", F.lit("train")), d, regularization)[1]


def ridge_fit_with_validation(encoded: DataFrame, d: int, regularization: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on the rows whose ``split`` is train, and on all rows:
    one pass gathers both Gram matrices."""
    size = d * d + d

    def partial(x: np.ndarray, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
        parts = [(x[mask], y[mask]) for mask in (fit, ~fit)]
        return np.concatenate([np.concatenate([(a.T @ a).ravel(), a.T @ b]) for a, b in parts])

    with StoredBlocks(encoded.withColumn("fit", F.col("split") == "train"), d) as blocks:
        sums = blocks.total(2 * size, partial)
    return _ridge(sums[:size], d, regularization), _ridge(sums[:size] + sums[size:], d, regularization)


def _gradients(weights: list[np.ndarray], k: int):
    """Gradient, loss and row count of each weight matrix; all but the last see
    only the rows marked ``fit``."""
    def partial(x: np.ndarray, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
        out = []
        for j, w in enumerate(weights):
            xs, ys = (x, y) if j == len(weights) - 1 else (x[fit], y[fit])
            ys = ys.astype(np.int64)
            s = xs @ w
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            at = np.arange(len(ys)), ys
            loss = -np.log(np.clip(p[at], 1e-12, 1.0)).sum()
            p[at] -= 1.0
            out.append(np.concatenate([(xs.T @ p).ravel(), [loss, len(ys)]]))
        return np.concatenate(out)
    return partial


def _descend(encoded: DataFrame, d: int, k: int, fits: int, learning_rate: float, iterations: int,
             regularization: float) -> list[np.ndarray]:
    """Full-batch gradient descent of ``fits`` models side by side, one
    distributed pass per iteration for all of them; a model stops when its
    loss changes by less than 1e-9."""
    weights = [np.zeros((d, k)) for _ in range(fits)]
    previous, active = [float("inf")] * fits, set(range(fits))
    with StoredBlocks(encoded, d) as blocks:
        for _ in range(iterations):
            if not active:
                break
            got = blocks.total(fits * (d * k + 2), _gradients(weights, k)).reshape(fits, -1)
            for j in sorted(active):
                n = got[j, -1] or 1.0
                grad = got[j, :d * k].reshape(d, k) / n
                grad[1:] += regularization * weights[j][1:]
                weights[j] = weights[j] - learning_rate * grad
                loss = got[j, -2] / n
                if abs(previous[j] - loss) < 1e-9:
                    active.discard(j)
                previous[j] = loss
    return weights


def softmax_fit(encoded: DataFrame, d: int, k: int, learning_rate: float = 0.05, iterations: int = 500,
                regularization: float = 0.001) -> np.ndarray:
    """Full-batch gradient descent from zero weights, L2 off the intercept."""
    return _descend(encoded.withColumn("fit", F.lit(True)), d, k, 1, learning_rate, iterations, regularization)[0]


def softmax_fit_with_validation(encoded: DataFrame, d: int, k: int, learning_rate: float = 0.05,
                                iterations: int = 500, regularization: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on the rows whose ``split`` is train, and on all rows, in
    the same passes."""
    marked = encoded.withColumn("fit", F.col("split") == "train")
    train, every = _descend(marked, d, k, 2, learning_rate, iterations, regularization)
    return train, every


def predict_regression(x: Column, weights: np.ndarray, log1p: bool = False) -> Column:
    """Dot product with literal weights; ``expm1`` when the target was log1p'd."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.expm1(dot) if log1p else dot


def classify(x: Column, weights: np.ndarray, labels: list[str]) -> Column:
    """Stable softmax over ``x·W`` → ranked ``array<struct<label, score>>``,
    ties in the order of ``labels``; a matrix product per Arrow batch."""
    w, names = np.array(weights, dtype=np.float64), np.array(labels, dtype=object)
    d, k = w.shape

    @F.arrow_udf("array<struct<label: string, score: double>>")
    def ranked(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        rows = np.asarray(_doubles(column.drop_null()), np.float64).reshape(-1, d)
        step = max(1, BLOCK_ROWS * 8 // max(d, k))
        order, scores = np.empty((len(rows), k), np.int64), np.empty((len(rows), k))
        for at in range(0, len(rows), step):
            s = rows[at:at + step] @ w
            e = np.exp(s - s.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            order[at:at + step] = np.argsort(-e, axis=1, kind="stable")
            scores[at:at + step] = np.take_along_axis(e, order[at:at + step], axis=1)
        label = pa.DictionaryArray.from_arrays(pa.array(order.ravel(), pa.int64()), pa.array(names, pa.string())).dictionary_decode()
        items = pa.StructArray.from_arrays([label, pa.array(scores.ravel())], ["label", "score"])
        ends = np.concatenate([[0], np.cumsum(known) * k]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), items, mask=None if known.all() else pa.array(~known))
    return ranked(x)


def regression_metrics(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """MAE, RMSE and R² (0 when the truth has no variance) in one pass."""
    err = F.col(prediction) - F.col(truth)
    agg = df.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.sum(err * err).alias("sse"), F.var_pop(truth).alias("vp"), F.count(F.lit(1)).alias("n"))
    ss_tot = F.col("vp") * F.col("n")
    return agg.select("mae", "rmse", F.when(ss_tot > 0, 1 - F.col("sse") / ss_tot).otherwise(0.0).alias("r2"))


def accuracy(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(truth)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def fit_tabular(df: DataFrame, features: list[str], target: str, objective: str = "regression",
                test_split: float = 0.2, seed: int = 42, maximum_categories: int = 50,
                regularization: float = 0.001, target_transform: str = "none", learning_rate: float = 0.05,
                iterations: int = 500, id_col: str = "__sw_sn") -> dict[str, Any]:
    """Split → schema on training rows → fit on training rows → validation
    metric → refit on all rows.  Returns the predictor as a dict."""
    from ..plans.ordering import split_train_validation

    names = {c.lower() for c in (*features, target, id_col, "__sw_sn")}
    df = df.select(*[c for c in df.columns if c.lower() in names])
    n = df.count()
    if n < 5:
        raise ValueError("Use at least five valid tabular records.")
    split = split_train_validation(df, id_col, test_split, seed, total=n)
    if id_col.lower() not in {c.lower() for c in (*features, target, "__sw_sn")}:
        split = split.drop(id_col)   # the split is all that it was needed for
    split = split.persist()
    try:
        train = split.filter(F.col("split") == "train")
        schema = _feature_schema(train, features, maximum_categories)   # of rows that are stored already
        if not schema:
            raise ValueError("No usable predictor columns remained after preparation.")
        x = encode(split, schema)
        d = 1 + sum(1 if f.kind == "numeric" else len(f.categories) + 1 for f in schema)
        out: dict[str, Any] = {"objective": objective, "features": [f.__dict__ for f in schema], "dimensions": d}
        if objective == "regression":
            y = py_float(F.col(target), dtype_of(df, target))
            bad = split.filter(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).limit(1).count()
            if bad:
                raise ValueError("Regression targets must all be finite numbers.")
            if target_transform == "log1p":
                if split.filter(y < 0).limit(1).count():
                    raise ValueError("The log1p target transform requires non-negative targets.")
                yf = F.log1p(y)
            else:
                yf = y
            enc = split.select(x.alias("x"), yf.alias("y"), y.alias("truth"), "split")
            w_val, w_all = ridge_fit_with_validation(enc, d, regularization)
            scored = enc.filter(F.col("split") == "validation").withColumn(
                "pred", predict_regression(F.col("x"), w_val, target_transform == "log1p"))
            metrics = regression_metrics(scored, "pred", "truth").first().asDict()
            out["weights"] = w_all.tolist()
            out["metrics"] = metrics
            out["target_transform"] = target_transform
        else:
            found = (split.select(py_str(F.col(target), dtype_of(df, target)).alias("t")).distinct()
                     .limit(MAXIMUM_CLASSES + 1).collect())
            if len(found) > MAXIMUM_CLASSES:
                raise ValueError(f"Classification takes at most {MAXIMUM_CLASSES} target classes.")
            labels = sorted(r[0] for r in found)
            if len(labels) < 2:
                raise ValueError("Classification requires at least two target classes.")
            index = F.array_position(F.array(*[F.lit(lb) for lb in labels]),
                                     py_str(F.col(target), dtype_of(df, target))) - 1
            enc = split.select(x.alias("x"), index.cast("long").alias("y"), "split")
            k = len(labels)
            w_val, w_all = softmax_fit_with_validation(enc, d, k, learning_rate, iterations, regularization)
            ranked = enc.filter(F.col("split") == "validation").withColumn("r", classify(F.col("x"), w_val, labels))
            acc = ranked.select((F.array_position(F.array(*[F.lit(lb) for lb in labels]), F.col("r")[0]["label"]) - 1)
                                .alias("p"), "y")
            out["metrics"] = {"accuracy": accuracy(acc, "p", "y").first()["accuracy"]}
            out["weights"] = w_all.tolist()
            out["labels"] = labels
        return out
    finally:
        split.unpersist()


def save_predictor(model: dict[str, Any], directory: str, checkpoints: list[dict[str, Any]] | None = None) -> None:
    """``predictor.json`` + ``metadata.json``; intermediate fits go below
    ``checkpoint-N/`` (kept out of published artifacts by the allow-list)."""
    from ..sinks.files import write_json

    d = directory.rstrip("/")
    write_json(f"{d}/predictor.json", {k: v for k, v in model.items() if k != "metrics"})
    write_json(f"{d}/metadata.json", {"metrics": model.get("metrics"), "dimensions": model.get("dimensions")})
    for i, ck in enumerate(checkpoints or [], 1):
        write_json(f"{d}/checkpoint-{i}/predictor.json", ck)
