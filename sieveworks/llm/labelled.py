"""Labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize

BROADCAST_LABELS = 2_000_000   # (id, label) rows sent to every executor at most


def labelled_texts(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_col: str,
                   name: str) -> tuple[DataFrame, int, int]:
    """(label, text, draw) of the documents with label 0 or 1, and how many of
    label 1 and of label 0 there are.  ``draw`` is a hash of the id, for
    samples."""
    known = materialize(labelled.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
                        .filter("__id IS NOT NULL AND label IN (0, 1)"), name)
    if known.count() <= BROADCAST_LABELS:   # else both sides are shuffled, with the same result
        known = F.broadcast(known)
    train = (docs.join(known, F.col(id_col) == F.col("__id"))
             .select("label", F.col(text_col).alias("text"), F.xxhash64("__id", F.lit(5)).alias("draw")))
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return train, totals.get(1, 0), totals.get(0, 0)


def drawn(train: DataFrame, sample: int, rows: int) -> DataFrame:
    """About ``sample`` of ``rows`` labelled rows, chosen by ``draw``."""
    chance = min(1.0, sample / max(1, rows))
    return train.filter(F.pmod("draw", F.lit(1 << 20)) < int(chance * (1 << 20)))
