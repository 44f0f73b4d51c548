"""Tensor-table compatibility and weighted merge.

A model is a table ``(name, shape array<int>, values array<float>)``.  The
compatibility report is a full outer join on ``name`` reduced by one
aggregate; the merge is one full outer join, stored once, plus ``zip_with`` in
float32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: tensor counts, names/shape checks and failing check names."""
    j = (a.select("name", F.col("shape").alias("sa")).join(b.select("name", F.col("shape").alias("sb")), "name",
                                                            "full_outer"))
    agg = j.agg(
        F.count("sa").alias("tensors_a"), F.count("sb").alias("tensors_b"),
        F.count_if(F.col("sb").isNull()).alias("missing_in_b"),
        F.count_if(F.col("sa").isNull()).alias("missing_in_a"),
        F.count_if(F.col("sa").isNotNull() & F.col("sb").isNotNull() & (F.col("sa") != F.col("sb")))
        .alias("shape_mismatches"))
    names_ok = (F.col("tensors_a") > 0) & (F.col("missing_in_a") == 0) & (F.col("missing_in_b") == 0)
    shapes_ok = names_ok & (F.col("shape_mismatches") == 0)
    blockers = F.concat_ws(",", F.when(~names_ok, F.lit("tensor_names")), F.when(~shapes_ok, F.lit("tensor_shapes")))
    return agg.select("tensors_a", "tensors_b", "missing_in_b", "missing_in_a", "shape_mismatches",
                      names_ok.alias("tensor_names"), shapes_ok.alias("tensor_shapes"), blockers.alias("blockers"))


def weighted_merge(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float) -> DataFrame:
    """``a·wa + b·wb`` per tensor in float32; weights ≥ 0 summing to 1 ± 1e-6.

    Models that differ in tensor names, shapes or numbers of values are
    refused, so no tensor is dropped and no value becomes null."""
    if weight_a < 0 or weight_b < 0 or abs(weight_a + weight_b - 1.0) > 1e-6:
        raise ValueError("Linear merge weights must be non-negative and sum to 1.0.")
    # one join checks and merges: rows that can't be merged carry the reason
    from ..session import materialize

    wa, wb = F.lit(weight_a).cast("float"), F.lit(weight_b).cast("float")
    j = a.select("name", F.col("shape").alias("sa"), F.col("values").alias("va")).join(
        b.select("name", F.col("shape").alias("sb"), F.col("values").alias("vb")), "name", "full_outer")
    reason = (F.when(F.col("sa").isNull() | F.col("sb").isNull(), "tensor_names")
              .when(F.col("sa") != F.col("sb"), "tensor_shapes")
              .when(F.size("va") != F.size("vb"), "tensor_values"))
    merged = F.zip_with("va", "vb", lambda x, y: ((x.cast("float") * wa).cast("float") + (y.cast("float") * wb)
                                                  .cast("float")).cast("float"))
    rows = materialize(j.select("name", F.col("sa").alias("shape"), F.when(reason.isNull(), merged).alias("values"),
                                reason.alias("reason")), "merged")
    reasons = rows.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons")).first()
    if reasons["reasons"] or not reasons["n"]:
        raise ValueError(f"The models cannot be merged: {', '.join(reasons['reasons'] or ['tensor_names'])} differ.")
    return rows.drop("reason")
