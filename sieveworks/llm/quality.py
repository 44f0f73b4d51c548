"""Quality scores by naive-Bayes support vectors.

Each text becomes a set of n-gram indicators: single words, and sequences of
one to three word shapes (``Thre***`` has the shape ``Aaa**``; a word that
repeats the one before it is marked), hashed into a fixed number of buckets.
Every indicator is scaled by the log-count ratio of its bucket between the
classes, and a linear classifier with hinge loss is fitted on the scaled,
length-normalised vectors by dual coordinate descent.  Margins become
probabilities through a logistic curve fitted on margins of rows that the
margin's own classifier has not seen.

The ratios are counted over all labelled training rows; the classifier is
fitted on at most ``SAMPLE_ROWS`` of them, chosen by a hash of their id.  Every
document is scored over its whole text, and scores read the text only.

Defined cases: null and empty texts have no indicators and score by the bias;
a label that is neither 0 nor 1 is not learned from; labels repeated for a
document count each time; without labelled rows of both classes every score
is the share of label 1 (0 without any); columns named like a result column
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_append, slices, spark_schema_with
from .labelled import drawn, labelled_texts
from .near_dup import mix

BUCKETS = 1 << 17          # of words, and as many of shapes
SAMPLE_ROWS = 8_000
SMOOTHING = 1.0
COST = 1.0                 # of a margin violation
EPOCHS = 20
KEEP_FROM = 0.7
WORDS_REMEMBERED = 200_000


def shape(word: str) -> str:
    """Letters by case, digits, other marks as they are; runs of two or more
    of one kind count as two."""
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 2 or out[-1] != kind or out[-2] != kind:
            out.append(kind)
    return "".join(out)


class Indicators:
    """Texts to the sorted buckets of their n-grams."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _codes(self, word: str) -> tuple[int, int]:
        if len(self.known) >= WORDS_REMEMBERED:
            self.known.clear()
        codes = self.known[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape(word)))
        return codes

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.empty(0, dtype=np.int32)
        known = self.known
        codes = list(map(known.get, words))
        if None in codes:
            for i in [i for i, c in enumerate(codes) if c is None]:
                codes[i] = known.get(words[i]) or self._codes(words[i])
        both = np.array(codes, dtype=np.uint64)
        word, form = both[:, 0], both[:, 1].copy()
        form[1:][word[1:] == word[:-1]] += np.uint64(1)   # repeats the word before it
        grams = [mix(form)]
        for _ in range(2):
            if len(grams[-1]) > 1:
                n = len(grams[-1]) - 1
                grams.append(mix(grams[-1][:n] * np.uint64(0x100000001B3) + form[-n:]))
        forms = np.unique(np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int32)
        return np.concatenate([forms, np.unique(mix(word) % np.uint64(BUCKETS)).astype(np.int32) + BUCKETS])


def log_count_ratios(train: DataFrame, n: int = 2 * BUCKETS) -> np.ndarray:
    """Per bucket, over all training rows."""
    def run(batches):
        indicators, counts = Indicators(), np.zeros((2, n), dtype=np.int64)
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, indicators.of(text)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"k": at.astype(np.int32), "p": counts[1, at], "q": counts[0, at]})

    rows = (train.select("label", "text").mapInArrow(run, "k int, p long, q long")
            .groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas())   # at most n rows
    p, q = np.full(n, SMOOTHING), np.full(n, SMOOTHING)
    p[rows["k"]] += rows["p"]
    q[rows["k"]] += rows["q"]
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int,
                            cost: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Linear hinge-loss classifier (weights, bias) of sparse rows; each row's
    dual variable moves to its best value between 0 and its cost in turn."""
    w, b = np.zeros(n), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to label 1, with the
    targets drawn in a little, as few rows of a class ask for."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * theta), -2, 2)
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray):
    """Effective weight per bucket, bias, and the curve to probabilities."""
    y = np.where(labels > 0, 1.0, -1.0)
    values = []
    for at in rows:
        v = ratios[at]
        length = np.sqrt(v @ v)
        values.append(v / length if length > 0 else v)
    # the rarer class may err at a higher price
    rare = (labels > 0) == (labels.mean() < 0.5)
    cost = COST * np.where(rare, np.sqrt(0.5 / rare.mean()), 1.0)

    def part(index):
        return dual_coordinate_descent([rows[i] for i in index], [values[i] for i in index], y[index],
                                       len(ratios), cost[index])

    unseen = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 2
    for f in (0, 1):
        w, b = part(np.flatnonzero(fold != f)) if (fold != f).any() else (np.zeros(len(ratios)), 0.0)
        for i in np.flatnonzero(fold == f):
            unseen[i] = w[rows[i]] @ values[i] + b
    w, b = part(np.arange(len(rows)))
    return w, b, _curve(unseen, labels)


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``score`` and ``predicted``.

    ``labelled`` holds (id, label) of the rows to learn from; their texts come
    from ``docs``.
    """
    spark = docs.sparkSession
    train, n1, n0 = labelled_texts(docs, labelled, id_col, text_col, label_col, "quality-labels")
    ratios, w, b, curve = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS), 0.0, None
    if n1 and n0:
        ratios = log_count_ratios(train)

        def sample(batches):
            indicators = Indicators()
            for batch in slices(batches):
                found = [indicators.of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                    names=["label", "draw", "f"])

        got = (drawn(train, SAMPLE_ROWS, n1 + n0).mapInArrow(sample, "label int, draw long, f array<int>")
               .orderBy("draw", "label", F.size("f")).limit(SAMPLE_ROWS).toArrow())
        labels = got["label"].to_numpy()
        if 0 < labels.sum() < len(labels):
            rows = [r.values.to_numpy() for r in got["f"]]
            w, b, curve = fit(rows, labels, ratios)
    share = n1 / (n1 + n0) if n1 + n0 else 0.0
    shared = spark.sparkContext.broadcast((w * ratios, ratios * ratios, b, curve))   # 2 * BUCKETS numbers each
    kept = docs.columns if keep is None else keep

    def run(batches):
        weights, squares, bias, line = shared.value
        indicators = Indicators()
        for batch in slices(batches):
            out = np.full(batch.num_rows, share)
            if line is not None:
                for i, text in enumerate(batch.column(text_col).to_pylist()):
                    at = indicators.of(text)
                    length = np.sqrt(squares[at].sum())
                    margin = (weights[at].sum() / length if length > 0 else 0.0) + bias
                    out[i] = 1 / (1 + np.exp(-np.clip(line[0] * margin + line[1], -700, 700)))
            yield arrow_append(batch.select(kept), [("score", pa.array(out)), (
                "predicted", pa.array((out >= KEEP_FROM).astype(np.int32)))])

    source = docs.select(*dict.fromkeys([*kept, text_col]))
    return source.mapInArrow(run, spark_schema_with(
        source.select(*kept), [("score", T.DoubleType()), ("predicted", T.IntegerType())]))
