"""Approximate nearest neighbours by cosine: robust-pruned directed graphs.

Vectors are dealt to shards of bounded size by a hash of their row.  In each
shard a directed graph is grown: a greedy beam search from the shard's entry
point proposes neighbours for a vector, relaxed distance pruning keeps a
diverse few of them (a candidate is dropped when a kept neighbour is closer to
it than the vector by the factor ``alpha``), and back edges are pruned the same
way.  Queries run a beam search in every shard and the shards' answers are
merged; scores are the exact cosines of the original vectors in double
precision.

Every row is indexed.  Equal vectors of a shard share one node, which answers
with its rows' smallest ids, so that thousands of copies neither crowd out
the beam nor hide a smaller id.

Defined cases: rows with a null id, or a vector that is null, zero, empty or
holds a null or non-finite component, take no part; vectors meet only
vectors of their own dimension; a row repeated with the same id and vector
counts once; candidates exclude all rows with the query's id; ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize
from .vectors import merge_top, packs, valid_rows

SHARD_ROWS = 4096
PACK_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
TOGETHER = 256   # searches run in step

_INDEX = "shard string, node int, id long, vec array<double>, edges array<int>, entry int"
_FOUND = "key long, query_id long, vec_id long, score double"


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int):
    """Greedy searches of several queries in step.  Returns per query the
    nodes of the final beam, best first (-1: none), and the nodes expanded."""
    b, n = len(queries), len(unit)
    ids = np.full((b, beam), -1, dtype=np.int64)
    sims = np.full((b, beam), -np.inf)
    done = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, entry] = entry, queries @ unit[entry], False, True
    expanded = []
    while True:
        open_rows = np.flatnonzero(~done.all(axis=1))
        if len(open_rows) == 0:
            break
        at = (~done[open_rows]).argmax(axis=1)
        node = ids[open_rows, at]
        done[open_rows, at] = True
        went = np.full(b, -1, dtype=np.int64)
        went[open_rows] = node
        expanded.append(went)
        next_ids = edges[node]
        fresh = (next_ids >= 0) & ~seen[open_rows[:, None], next_ids]
        rows, cols = np.nonzero(fresh)
        seen[open_rows[rows], next_ids[rows, cols]] = True
        near = np.einsum("ard,ad->ar", unit[next_ids], queries[open_rows])
        near[~fresh] = -np.inf
        all_sims = np.concatenate([sims[open_rows], near], axis=1)
        all_ids = np.concatenate([ids[open_rows], np.where(fresh, next_ids, -1)], axis=1)
        all_done = np.concatenate([done[open_rows], ~fresh], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[open_rows] = np.take_along_axis(all_ids, order, axis=1)
        sims[open_rows] = np.take_along_axis(all_sims, order, axis=1)
        done[open_rows] = np.take_along_axis(all_done, order, axis=1)
    return ids, np.stack(expanded, axis=1)


def robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the kept neighbours among its candidates (-1: no
    candidate), nearest first."""
    order = np.sort(candidates, axis=1)
    again = np.zeros_like(order, dtype=bool)
    again[:, 1:] = order[:, 1:] == order[:, :-1]
    alive = (order >= 0) & ~again & (order != points[:, None])
    vectors = unit[order]
    away = 1.0 - np.einsum("bmd,bd->bm", vectors, unit[points])
    kept = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for r in range(degree):
        if not alive.any():
            break
        pick = np.where(alive, away, np.inf).argmin(axis=1)
        have = alive[rows, pick]
        kept[have, r] = order[rows, pick][have]
        between = 1.0 - np.einsum("bmd,bd->bm", vectors, vectors[rows, pick])
        alive &= (alpha * between > away) | ~have[:, None]
        alive[rows, pick] = False
    return kept


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1: none) and the entry node of one shard."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    entry = int((unit @ unit.mean(axis=0)).argmax())
    edges = np.full((n, degree), -1, dtype=np.int64)
    if n > 1:
        start = min(degree // 2, n - 1)
        edges[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, size=(n, start))) % n
    order = rng.permutation(n)
    for at in range(0, n, TOGETHER):
        points = order[at:at + TOGETHER]
        beam_ids, expanded = beam_search(unit, edges, entry, unit[points], beam)
        pool = np.concatenate([beam_ids, expanded, edges[points]], axis=1)
        edges[points] = robust_prune(unit, points, pool, degree, alpha)
        # back edges: each target gets the points that chose it
        rows, cols = np.nonzero(edges[points] >= 0)
        target, source = edges[points][rows, cols], points[rows]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(hit), int(count.max(initial=0))), -1, dtype=np.int64)
        slot = np.arange(len(target)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(hit)), count), slot] = source
        for some in range(0, len(hit), TOGETHER):
            part = hit[some:some + TOGETHER]
            edges[part] = robust_prune(unit, part, np.concatenate([edges[part], back[some:some + TOGETHER]], axis=1),
                                       degree, alpha)
    return edges, entry


def _units(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small numbers stay finite
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    vectors = _matrix(pdf["vec"])
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    edges, entry = build_graph(_units(distinct))
    node = node.reshape(-1)
    return pd.DataFrame({"shard": pdf["shard"], "node": node, "id": pdf["id"], "vec": list(vectors),
                         "edges": [edges[i][edges[i] >= 0] for i in node], "entry": entry})


def build_index(vectors: DataFrame, id_col: str, vec_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graph of every shard as a table: one row per vector with its node,
    its node's out-edges and its shard's entry node."""
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = materialize(valid_rows(vectors, id_col, vec_col, doubles).filter(F.exists("vec", lambda x: x != 0)),
                       "ann-vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("n_shards"))
    dealt = rows.join(sizes, "dim").withColumn(
        "shard", F.concat_ws(":", "dim", F.pmod(F.xxhash64("id", "vec"), F.col("n_shards")).cast("int")))
    return dealt.select("shard", "id", "vec").groupBy("shard").applyInPandas(_build, _INDEX)


def _search(k: int, beam: int):
    def cell(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(index) == 0 or len(queries) == 0:
            return pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []})
        index = index.sort_values(["node", "id"], kind="stable")
        nodes, start, count = np.unique(index["node"].to_numpy(), return_index=True, return_counts=True)
        ids = index["id"].to_numpy()
        one = index.iloc[start]
        vectors = _matrix(one["vec"])
        unit = _units(vectors)
        edges = np.full((len(nodes), max(1, max(map(len, one["edges"])))), -1, dtype=np.int64)
        for i, found in enumerate(one["edges"]):
            edges[i, :len(found)] = found
        asked = _matrix(queries["vec"])
        q_unit = _units(asked)
        entry = int(index["entry"].iloc[0])
        keys, query_ids = queries["key"].tolist(), queries["id"].tolist()
        out = []
        for at in range(0, len(asked), TOGETHER):
            found, _ = beam_search(unit, edges, entry, q_unit[at:at + TOGETHER], beam)
            for row, best in enumerate(found):
                best = best[best >= 0]
                cosine = (unit[best] * q_unit[at + row]).sum(axis=1)
                key, query_id = keys[at + row], query_ids[at + row]
                mine = [(-s, int(i)) for s, node in zip(cosine.tolist(), best, strict=True)
                        for i in ids[start[node]:start[node] + min(count[node], k + 1)] if i != query_id]
                out.extend((key, query_id, i, -s) for s, i in sorted(mine)[:k])
        return pd.DataFrame(out, columns=["key", "query_id", "vec_id", "score"])
    return cell


def search(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5,
           beam: int = SEARCH_BEAM) -> DataFrame:
    """Nearest rows of each query row: (query_id, rank, vec_id, score)."""
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    asked = valid_rows(queries, id_col, vec_col, doubles).filter(F.exists("vec", lambda x: x != 0))
    asked = packs(materialize(asked.withColumn("key", F.monotonically_increasing_id()), "ann-queries"), PACK_ROWS)
    shards = index.select(F.col("shard").alias("shard")).distinct().withColumn("dim", F.split("shard", ":")[0].cast("int"))
    visits = asked.join(shards, "dim")
    # renamed, so that both sides of the cogroup have columns of their own
    cells = visits.select(F.col("shard").alias("shard"), F.col("pack").alias("pack")).distinct()
    found = (index.join(cells, "shard").groupBy("shard", "pack")
             .cogroup(visits.select("key", "id", "vec", "shard", "pack").groupBy("shard", "pack"))
             .applyInPandas(_search(k, beam), _FOUND))
    return merge_top(found, k)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """Index every row of ``vectors`` and search it for every query row."""
    return search(materialize(build_index(vectors, id_col, vec_col), "ann-index"), queries, id_col, vec_col, k)
