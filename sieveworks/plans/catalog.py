"""Catalog questions as relational operators.

Every operator is a filter, an equi-join or an aggregate; Catalyst and AQE
pick the join strategy from runtime sizes (a small side becomes a broadcast
only after AQE measured it).  Per-key "latest" is a maximum instead of a window: a
sort-based aggregate, but with a partial step on the map side, so a key
holding a third of all rows is reduced before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_items(items: DataFrame, states: DataFrame, owner, *, item: str, owner_col: str, public: Column,
                  state_item: str, state_owner: str, archived: Column) -> DataFrame:
    """(public OR owned) AND NOT archived by this owner; public only without
    owner.  A set of rows: ``newest_first`` orders it for display."""
    if owner is None:
        return items.filter(public)
    hidden = states.filter((F.col(state_owner) == F.lit(owner)) & archived).select(F.col(state_item).alias("__sw_i"))
    keep = items.filter(public | (F.col(owner_col) == F.lit(owner)))
    return keep.join(hidden, keep[item] == hidden["__sw_i"], "left_anti")


def archived_items(items: DataFrame, states: DataFrame, owner, *, item: str, state_item: str, state_owner: str,
                   archived: Column) -> DataFrame:
    mine = (states.filter((F.col(state_owner) == F.lit(owner)) & archived)
            .select(F.col(state_item).alias("__sw_i")).distinct())
    return items.join(mine, items[item] == mine["__sw_i"], "inner").drop("__sw_i")


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The whole row with the greatest ``order`` per key."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    row, by = F.struct(*[F.col(c) for c in rest]), [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    if re.search(r"\b(map<|variant\b)", df.select(*rest).schema.simpleString()):   # these have no order
        best = F.max_by(row, F.struct(*by)).alias("__sw_row")
        return df.groupBy(*keys).agg(best).select(*keys, "__sw_row.*")
    # one maximum that carries the row takes half the time of a max_by
    best = F.max(F.struct(*by, row.alias("row"))).alias("__sw_best")
    return df.groupBy(*keys).agg(best).select(*keys, "__sw_best.row.*")


def newest_first(items: DataFrame, created: str, item: str) -> DataFrame:
    """Display order of a catalog list: newest first, then by item."""
    return items.orderBy(F.col(created).desc_nulls_last(), F.col(item))


def next_version(versions: DataFrame, key: str, number: str) -> DataFrame:
    return versions.groupBy(key).agg((F.max(number) + 1).alias("next_version"))


def latest_with_fallback(items: DataFrame, versions: DataFrame, *, item: str, fork_of: str, version_item: str,
                         order: list[str], value: list[str], fork_version: list[str] | None = None) -> DataFrame:
    """Own latest version; without one, the version of the fork source that the
    item records (``fork_version``: columns of ``items`` that match ``order``),
    or the source's latest where none is recorded."""
    latest = latest_per_key(versions.select(version_item, *order, *[v for v in value if v not in order]),
                            version_item, order)
    own = latest.select(F.col(version_item).alias("__sw_o"), *[F.col(v).alias(f"own_{v}") for v in value])
    if fork_version:
        every = versions.select(version_item, *dict.fromkeys([*order, *value]))
        src = every.select(F.col(version_item).alias("__sw_f"), *[F.col(o).alias(f"__sw_at{i}") for i, o in
                                                                  enumerate(order)],
                           *[F.col(v).alias(f"fork_{v}") for v in value])
        recorded = items[fork_of] == src["__sw_f"]
        for i, c in enumerate(fork_version):
            recorded = recorded & (items[c] == src[f"__sw_at{i}"])
    else:
        src = latest.select(F.col(version_item).alias("__sw_f"), *[F.col(v).alias(f"fork_{v}") for v in value])
        recorded = items[fork_of] == src["__sw_f"]
    j = items.join(own, items[item] == own["__sw_o"], "left").join(src, recorded, "left")
    has_own = F.col("__sw_o").isNotNull()
    cols = [F.when(has_own, F.col(f"own_{v}")).otherwise(F.col(f"fork_{v}")).alias(v) for v in value]
    origin = F.when(has_own, "own").when(F.col("__sw_f").isNotNull(), "fork").alias("origin")
    return j.select(F.col(item), *cols, origin)


def resolve_precedence(df: DataFrame, key: str, candidates: list[str], default: str) -> DataFrame:
    """First non-empty value among the ``candidates`` columns (already joined
    onto ``df`` with left joins, in precedence order); ``default`` when all are
    empty.  Adds the winning level's name."""
    vals = [F.nullif(F.col(c), F.lit("")) for c in candidates]
    level = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, n in zip(vals, candidates)], F.lit("default"))
    return df.select(F.col(key), F.coalesce(*vals, F.lit(default)).alias("value"), level.alias("level"))


def runnable_items(visible: DataFrame, versions: DataFrame, *, item: str, version_item: str, order: list[str],
                   usable: Column, fork_of: str | None = None, fork_version: list[str] | None = None) -> DataFrame:
    """Visible items whose latest version is usable (left semi join); with
    ``fork_of``, items without a version of their own count by the version
    that ``latest_with_fallback`` finds."""
    if fork_of:
        value = [c for c in versions.columns if c != version_item]
        chosen = latest_with_fallback(visible, versions, item=item, fork_of=fork_of, version_item=version_item,
                                      order=order, value=value, fork_version=fork_version)
        latest = chosen.filter("origin IS NOT NULL").filter(usable).select(F.col(item).alias("__sw_i"))
    else:
        latest = (latest_per_key(versions, version_item, order).filter(usable)
                  .select(F.col(version_item).alias("__sw_i")))
    return visible.join(latest, visible[item] == latest["__sw_i"], "left_semi")


def recent_distinct(items: DataFrame, uses: DataFrame, *, item: str, use_item: str, ts: str) -> DataFrame:
    """Items by most recent use, then the unused rest (item order): adds
    ``last_used`` and a dense ``position``."""
    from .ordering import with_global_position

    last = uses.groupBy(use_item).agg(F.max(ts).alias("last_used"))
    j = items.select(item).join(last, items[item] == last[use_item], "left").select(item, "last_used")
    # only keys are ordered; the items' other columns join their position
    placed = with_global_position(j, [F.col("last_used").desc_nulls_last(), F.col(item)], "position")
    return items.join(placed, item) if len(items.columns) > 1 else placed


def conditional_counts(df: DataFrame, key: str, value: str, cases: dict[str, object]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col(value) == F.lit(v)).alias(name) for name, v in cases.items()])


def distinct_count(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias("distinct_count"))


def count_by_key(key: str, tables: dict[str, tuple[DataFrame, str]], keys: DataFrame | None = None) -> DataFrame:
    """Per-key counts from several tables, zero-filled (one aggregate per
    table, then key joins of the small per-key results)."""
    out = keys
    for name, (df, k) in tables.items():
        c = df.groupBy(F.col(k).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = c if out is None else out.join(c, key, "full_outer")
    return out.fillna(0, list(tables))


def global_counts(tables: dict[str, DataFrame], conditions: dict[str, tuple[DataFrame, Column]] | None = None):
    """One row: total rows per table plus conditional counts."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
               for name, df in tables.items()]
    counted += [df.agg(F.count_if(cond).alias("n")).select(F.lit(name).alias("name"), "n")
                for name, (df, cond) in (conditions or {}).items()]
    every = counted[0]
    for one in counted[1:]:
        every = every.unionAll(one)
    names = [*tables, *(conditions or {})]
    return every.groupBy().pivot("name", names).agg(F.first("n")).select(*names)


def toggle_state(clicks: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Final state of a click toggle per key: clicking the current value
    clears it, any other value replaces it.  Closed form: the last value
    ``v`` survives iff the final run of ``v`` clicks has odd length.  Three
    partial aggregates — no per-key list is ever collected."""
    o = F.struct(*[F.col(c) for c in order])
    # one small row per key and value, summed per task before the shuffle
    ends = clicks.groupBy(*key, value).agg(F.max(o).alias("__sw_o"))
    by_end = F.reverse(F.array_sort(F.collect_list(F.struct("__sw_o", F.col(value).alias("v")))))
    last = (ends.groupBy(*key).agg(by_end.alias("__sw_e"))
            .select(*key, F.col("__sw_e")[0]["v"].alias("__sw_v"), F.get("__sw_e", F.lit(1))["__sw_o"].alias("__sw_b")))
    # the final run: clicks after the last click of any other value
    j = clicks.join(last, key)
    run = (j.filter(F.col("__sw_b").isNull() | (o > F.col("__sw_b"))).groupBy(*key)
           .agg(F.first("__sw_v").alias("__sw_v"), F.count(F.lit(1)).alias("__sw_run")))
    return run.filter(F.col("__sw_run") % 2 == 1).select(*key, F.col("__sw_v").alias("state"))
