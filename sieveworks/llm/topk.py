"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length (Euclidean norm) into geometric bands, and each
band into blocks of bounded size.  A product can reach a score s only if
``|q| * |c| >= s``, so once a query knows a lower bound of its k-th best
score, whole bands drop out before anything is sent to them, and inside a
block the bound becomes a local cosine threshold ``s / (|q| * longest)``:

* above 1 the block is skipped;
* a low threshold uses length pruning (only the longest vectors of the block,
  a prefix of its order by norm);
* a high threshold uses coordinate pruning as well: for the query's largest
  coordinates, the coordinate of a unit vector within that angle lies in a
  narrow interval.

The survivors' products are then computed exactly, as integers.  Bounds carry
a small slack for rounding, so pruning never drops a result.

Queries and vectors meet in a grid of (block, pack of queries): both sides of
a cell are bounded, and every query reaches every block that its bound allows.

Defined cases: rows with a null id, a null vector or a component that is null
or not finite take no part; vectors meet only vectors of their own dimension;
a row repeated with the same id and vector counts once; candidates exclude
all rows with the query's id; ties go to the smaller id; a score beyond 64
bits counts as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize
from .vectors import merge_top, packs, valid_rows

BAND_WIDTH = 0.05        # of the natural logarithm of the norm
BLOCK_ROWS = 8192
PACK_ROWS = 4096
FOCUS = 3                # coordinates tried by coordinate pruning
COORDINATE_FROM = 0.3    # local cosine threshold from which it pays
SLACK = 1e-9

_FOUND = "key long, query_id long, vec_id long, score long"


def _products(block: np.ndarray, q: np.ndarray, exact_float: bool, exact_int: bool) -> np.ndarray:
    if exact_float:
        return block @ q
    if exact_int:
        return block.astype(np.int64) @ q.astype(np.int64)
    wide = block.astype(object) @ q.astype(object)
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, int(x))) for x in wide], dtype=np.int64)


def search_block(ids: np.ndarray, block: np.ndarray, keys, query_ids, queries: np.ndarray, thetas, k: int):
    """Top ``k`` of one block for each query that may find any there."""
    peak = float(np.abs(block.astype(np.float64)).max(initial=0.0)) * float(
        np.abs(queries.astype(np.float64)).max(initial=0.0)) * max(1, block.shape[1])
    exact_float, exact_int = peak < 2.0 ** 52, peak < 2.0 ** 62
    unit = block.astype(np.float64)
    norms = np.sqrt((unit * unit).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids, block, unit, norms = ids[order], block[order], unit[order], norms[order]
    longest = norms[0] if len(norms) else 0.0
    if exact_float:
        block = unit
    unit = unit / np.where(norms > 0, norms, 1.0)[:, None]
    out = []
    for key, query_id, q, theta in zip(keys, query_ids, queries, thetas, strict=True):
        as_float = q.astype(np.float64)
        length = float(np.sqrt((as_float * as_float).sum()))
        near = slice(None)
        if theta is not None and theta > 0:
            reach = length * longest
            local = theta / reach * (1 - SLACK) if reach > 0 else np.inf
            if local > 1:
                continue
            # length pruning: the block is ordered by norm, longest first
            end = int(np.searchsorted(-norms, -(theta / length * (1 - SLACK)), side="right"))
            near = np.arange(end)
            if local >= COORDINATE_FROM:
                direction = as_float / length
                spread = np.sqrt(max(0.0, 1 - local * local))
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    mid, half = direction[f] * local, spread * np.sqrt(max(0.0, 1 - direction[f] ** 2))
                    low, high = mid - half, mid + half
                    if direction[f] >= local:
                        high = 1.0   # the axis itself lies within the angle
                    if -direction[f] >= local:
                        low = -1.0
                    x = unit[near, f]
                    near = near[(x >= low - 1e-7) & (x <= high + 1e-7)]
        scores = _products(block[near], as_float if exact_float else q, exact_float, exact_int)
        found = ids[near]
        own = found != query_id
        if theta is not None:
            own &= scores >= theta
        scores, found = scores[own], found[own]
        if len(found) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= cut
            scores, found = scores[keep], found[keep]
        best = sorted((-int(s), i) for s, i in zip(scores.tolist(), found.tolist(), strict=True))[:k]
        out.extend((key, query_id, i, -s) for s, i in best)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _cells(k: int):
    def cell(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(vectors) == 0 or len(queries) == 0:
            return pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        thetas = [None if pd.isna(t) else int(t) for t in queries["theta"]]
        rows = search_block(vectors["id"].to_numpy(), _matrix(vectors["vec"]), queries["key"].tolist(),
                            queries["id"].tolist(), _matrix(queries["vec"]), thetas, k)
        return pd.DataFrame(rows, columns=["key", "query_id", "vec_id", "score"], dtype="int64")
    return cell


def _grid(vectors: DataFrame, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Search the blocks that ``visits`` (key, block) names."""
    asked = queries.join(visits, "key")
    # renamed, so that both sides of the cogroup have columns of their own
    cells = asked.select(F.col("block").alias("block"), F.col("pack").alias("pack")).distinct()
    there = vectors.join(cells, "block").select("id", "vec", "block", "pack")
    return (there.groupBy("block", "pack")
            .cogroup(asked.select("key", "id", "vec", "theta", "block", "pack").groupBy("block", "pack"))
            .applyInPandas(_cells(k), _FOUND))


def exact_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10,
                scale: float = 1024.0) -> DataFrame:
    """The ``k`` largest inner products of ``floor(scale * x)`` for each query
    row: (query_id, rank, vec_id, score)."""
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    band = F.when(F.col("norm") > 0, F.floor(F.log("norm") / BAND_WIDTH)).otherwise(F.lit(-1_000_000)).cast("int")

    rows = valid_rows(vectors, id_col, vec_col, scaled).withColumn("norm", norm).withColumn("band", band)
    rows = materialize(rows, "topk-vectors")
    # bands of any size become blocks of bounded size: equal norms are split too
    bands = rows.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    bands = materialize(bands.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")), "topk-bands")
    name = F.concat_ws(":", "dim", "band", "part")
    placed = (rows.join(bands.select("dim", "band", "n_blocks"), ["dim", "band"])
              .withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("n_blocks")).cast("int"))
              .withColumn("block", name))
    blocks = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("block", name)

    asked = valid_rows(queries, id_col, vec_col, scaled).withColumn("norm", norm)
    asked = materialize(asked.withColumn("key", F.monotonically_increasing_id()), "topk-queries")
    asked = packs(asked, PACK_ROWS)

    # first the longest block of each dimension, for a lower bound of the k-th score
    first = blocks.groupBy("dim").agg(F.max_by("block", F.struct("longest", "n", F.col("block"))).alias("block"))
    seeds = _grid(placed, asked.withColumn("theta", F.lit(None).cast("long")),
                  asked.select("key", "dim").join(first, "dim").select("key", "block"), k)
    bound = seeds.groupBy("key").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    bound = bound.filter(F.col("n") >= k).select("key", F.col("low").alias("theta"))
    bounded = materialize(asked.join(bound, "key", "left"), "topk-bounds")

    # then every block whose longest vector can reach the bound
    reach = F.col("theta").isNull() | (F.col("theta") <= F.col("norm") * F.col("longest") * (1 + SLACK))
    visits = (bounded.select("key", "dim", "norm", "theta").join(blocks.select("dim", "block", "longest"), "dim")
              .filter(reach).select("key", "block"))
    return merge_top(_grid(placed, bounded, visits, k), k)
