"""Structured Streaming versions of the row pipeline, log tail, job state,
toggle state and n-gram counts.

Every stream reads files (the file source keeps its offsets in the
checkpoint) and runs with ``trigger(availableNow=True)``.  Given a ``state``
folder, a later call resumes where the last one stopped and its output adds
to the earlier one; without it the run starts fresh below the shared
checkpoint directory.  Each micro-batch is written to a folder named by its
batch number, so a batch that is run again after a failure replaces its own
output and no row appears twice.  Nothing is held in the driver.
"""

from __future__ import annotations

import bisect
from typing import Any, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import apply_operations
from ..session import scratch_path
from ..sinks.files import filesystem_for, remove_tree


def _run(query_df: DataFrame, name: str, mode: str = "append", state: str | None = None,
         progress: list | None = None) -> DataFrame:
    """Run a streaming DataFrame over all there is; returns its output so far
    (in complete mode: the last result)."""
    spark = query_df.sparkSession
    base = (state or scratch_path(spark, name)).rstrip("/")
    out = f"{base}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        place = "last" if mode == "complete" else f"batch={epoch}"
        batch.write.mode("overwrite").parquet(f"{out}/{place}")

    q = (query_df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    if mode == "complete":
        return spark.read.schema(query_df.schema).parquet(f"{out}/last")
    return spark.read.schema(query_df.schema).parquet(f"{out}/*")


COMPACT_EVERY = 32   # micro-batches whose changes are merged into one table


def _run_updates(query_df: DataFrame, name: str, keys: list[str], state: str | None = None,
                 compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Run a streaming aggregation in update mode; returns its result so far.

    A micro-batch writes only the keys that it changed, as ``full=0/epoch=N``.
    Every ``compact_every`` batches, the newest row of each key is written as
    ``full=1/epoch=N``, and what the compaction before covered is removed, so
    neither a batch nor the folder grows with the number of batches.  A batch
    that runs again replaces its own folders."""
    spark = query_df.sparkSession
    base = (state or scratch_path(spark, name)).rstrip("/")
    out, schema = f"{base}/out", query_df.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/full=0/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            _newest(batch.sparkSession, out, schema, keys, epoch).write.mode("overwrite").parquet(
                f"{out}/full=1/epoch={epoch}")
            gone = epoch - compact_every   # the compaction before this one is kept for readers at work
            for old in range(max(0, gone - compact_every + 1), gone + 1):
                remove_tree(f"{out}/full=0/epoch={old}")
            remove_tree(f"{out}/full=1/epoch={gone - compact_every}")

    q = (query_df.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return _newest(spark, out, schema, keys)


def _newest(spark: SparkSession, out: str, schema: T.StructType, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key: of the last compaction and the batches since."""
    parts = T.StructType([*schema.fields, T.StructField("full", T.IntegerType()), T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(parts).parquet(out)
    if upto is not None:
        rows = rows.filter(F.col("epoch") <= upto)
        rows = rows.filter((F.col("full") == 0) | (F.col("epoch") < upto))
    since = rows.filter("full = 1").agg(F.max("epoch")).first()[0]
    if since is not None:
        rows = rows.filter((F.col("epoch") > since) | ((F.col("full") == 1) & (F.col("epoch") == since)))
    rest = [c for c in schema.names if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in rest]), "epoch").alias("__sw_row")
    return rows.groupBy(*keys).agg(last).select(*keys, "__sw_row.*").select(*schema.names)


def _files(spark: SparkSession, schema, files_per_trigger: int | None):
    """A file stream; all new files form one batch unless a number is given."""
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def stream_pipeline(spark: SparkSession, source_glob: str, schema: str, operations: list[dict[str, Any]],
                    dedupe_on: list[str] | None = None, files_per_trigger: int | None = None,
                    state: str | None = None, within: tuple[str, str] | None = None,
                    progress: list | None = None) -> DataFrame:
    """Stateless operators on a file stream and de-duplication on a SHA-256 of
    the key columns.

    Without ``within`` it is exact over all times, and its state grows with
    the distinct keys, 32 bytes each.  ``within`` names a timestamp column and
    how late rows may come: then a key is forgotten once the watermark has
    passed its row by that much, so the state holds the keys of that span
    only, and copies that lie further apart both stay.  ``progress`` receives
    the reports of the run's micro-batches."""
    stream = _files(spark, schema, files_per_trigger).parquet(source_glob)
    out = apply_operations(stream, operations)
    if dedupe_on:
        # state keyed by a 32-byte digest of the key columns, not the text itself
        digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in dedupe_on])), 256)
        out = out.withColumn("__sw_h", digest)
        if within:
            # the event time may be a timestamp without zone, which has no watermark
            out = (out.withColumn("__sw_time", F.col(within[0]).cast("timestamp")).withWatermark("__sw_time", within[1])
                   .dropDuplicatesWithinWatermark(["__sw_h"]).drop("__sw_time"))
        else:
            out = out.dropDuplicates(["__sw_h"])
        out = out.drop("__sw_h")
    return _run(out, "pipeline", state=state, progress=progress)


def stream_event_tail(spark: SparkSession, log_dir: str, schema: str, files_per_trigger: int | None = None,
                      state: str | None = None) -> DataFrame:
    """Forward each JSONL log line once (file-source offsets in the checkpoint)."""
    return _run(_files(spark, schema, files_per_trigger).json(log_dir), "tail", state=state)


TERMINAL = ["completed", "failed", "cancelled"]


def job_state_aggregate(updates: DataFrame) -> DataFrame:
    """Latest status, stage and clamped progress per job; ``started_at`` =
    first running report, ``finished_at`` = last terminal report.  Works on
    batch and streaming DataFrames alike."""
    order = F.struct("ts", "seq")
    progress = F.least(F.lit(100), F.greatest(F.lit(0), F.col("progress").cast("int")))
    return updates.groupBy("job").agg(
        # a report without a status or stage leaves the last known one
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), order)).alias("stage"),
        F.max_by(progress, F.when(F.col("progress").isNotNull(), order)).alias("progress"),
        F.max("ts").alias("heartbeat"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("finished_at"),
    )


def stream_job_state(updates: DataFrame, state: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Job states of a stream of ``(job, status, stage, progress, ts, seq)``; a
    micro-batch writes the jobs that it reports on."""
    return _run_updates(job_state_aggregate(updates), "jobs", ["job"], state, compact_every)


_TOGGLE_OUT = "user_id long, state string, clicks long"
_TOGGLE_STATE = "state string, clicks long"


def _toggle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a user: the final run of a micro-batch, how many clicks the batch
    had, and whether the run is all of it."""
    current, clicks = (state.get if state.exists else (None, 0))
    # one row per earlier micro-batch, applied in their order
    for row in pd.concat(list(batches)).sort_values("epoch").itertuples():
        clicks += int(row.clicks)
        # a run that nothing else precedes goes on from the stored state
        odd = (row.run + (1 if row.whole and current == row.v else 0)) % 2 == 1
        current = row.v if odd else None
    state.update((current, clicks))
    yield pd.DataFrame({"user_id": [key[0]], "state": [current], "clicks": [clicks]})


def _final_runs(clicks: DataFrame) -> DataFrame:
    """One row per user of a batch: the last value, the length of its final run
    of equal clicks, whether that run is the whole batch, and all clicks.
    Aggregates only, so a user with most of a batch's clicks is summed per
    task first."""
    o = F.struct("ts", "event_id")
    ends = clicks.groupBy("user_id", "v").agg(F.max(o).alias("o"), F.count(F.lit(1)).alias("n"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("o", "v"))))
    last = (ends.groupBy("user_id").agg(ranked.alias("e"), F.sum("n").alias("clicks"))
            .select("user_id", "clicks", F.col("e")[0]["v"].alias("last"), F.get("e", F.lit(1))["o"].alias("border")))
    j = clicks.join(last, "user_id").filter(F.col("border").isNull() | (o > F.col("border")))
    return j.groupBy("user_id").agg(F.first("last").alias("v"), F.count(F.lit(1)).alias("run"),
                                    F.first("border").isNull().alias("whole"), F.first("clicks").alias("clicks"))


def stream_toggle(clicks: DataFrame, state: str | None = None) -> DataFrame:
    """Per-user toggle over a click stream ``(user_id, ts, event_id, v)``; each
    micro-batch's clicks are applied in (ts, event_id) order on top of the
    stored state.  A batch is first reduced to one row per user (its final
    run), so the state function never sees a user's clicks one by one."""
    spark = clicks.sparkSession
    base = (state or scratch_path(spark, "toggle")).rstrip("/")
    reduced = f"{base}/reduced"

    def reduce_batch(batch: DataFrame, epoch: int) -> None:
        (_final_runs(batch).withColumn("epoch", F.lit(epoch).cast("long"))
         .write.mode("overwrite").parquet(f"{reduced}/batch-{epoch:012d}"))

    q = (clicks.writeStream.option("checkpointLocation", f"{base}/clicks").foreachBatch(reduce_batch)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    runs = (spark.readStream.schema("user_id long, v string, run long, whole boolean, clicks long, epoch long")
            .option("maxFilesPerTrigger", 1_000_000).parquet(f"{reduced}/*"))
    states = runs.groupBy("user_id").applyInPandasWithState(
        _toggle, _TOGGLE_OUT, _TOGGLE_STATE, "update", GroupStateTimeout.NoTimeout)
    hist = _run(states, "toggle", mode="update", state=f"{base}/states")
    # the update with the most clicks is the final state of a user
    return hist.groupBy("user_id").agg(F.max_by("state", "clicks").alias("state")).filter(F.col("state").isNotNull())


_FOLD_OUT = "user_id long, state string, clicks long, waiting long"
_FOLD_STATE = "state string, clicks long, ts array<long>, ids array<long>, vs array<string>"


class ToggleFold(StatefulProcessor):
    """Folds a user's clicks in (ts, event_id) order, however they arrive.

    Clicks wait in the state until the watermark has passed them; then they are
    folded for good, in order, by a timer or with the next rows.  Every change
    reports the state with the waiting clicks folded on top, as a batch over
    the same clicks would."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("fold", _FOLD_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(int(r.us), int(r.event_id), r.v) for pdf in rows for r in pdf.itertuples()]
        yield self._advance(key, arrived, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, arrived: list[tuple[int, int, str]], timer_values) -> pd.DataFrame:
        current, clicks, ts, ids, vs = self._state.get() if self._state.exists() else (None, 0, [], [], [])
        waiting = sorted([*zip(ts, ids, vs), *arrived])
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        settled = bisect.bisect_right(waiting, passed, key=lambda c: c[0])
        current = _folded(current, waiting[:settled])
        waiting = waiting[settled:]
        clicks += len(arrived)
        self._state.update((current, clicks, [c[0] for c in waiting], [c[1] for c in waiting], [c[2] for c in waiting]))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if waiting:
            self._handle.registerTimer(waiting[-1][0] // 1000 + 1)
        return pd.DataFrame({"user_id": [key[0]], "state": [_folded(current, waiting)], "clicks": [clicks],
                             "waiting": [len(waiting)]})


def _folded(current: str | None, clicks: list[tuple[int, int, str]]) -> str | None:
    for _, _, v in clicks:
        current = None if v == current else v
    return current


def stream_toggle_ordered(clicks: DataFrame, lateness: str, state: str | None = None) -> DataFrame:
    """Per-user toggle over a click stream ``(user_id, ts timestamp, event_id,
    v)`` in (ts, event_id) order across micro-batches: clicks that come up to
    ``lateness`` late are put into their place.  One stateful query; the state
    of a user holds the clicks that the watermark has not passed."""
    spark = clicks.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    clicks = clicks.filter("ts IS NOT NULL")   # a click without a time has no place in the order
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        time = F.col("ts").cast("timestamp")
        timed = (clicks.select("user_id", time.alias("ts"), "event_id", "v", F.unix_micros(time).alias("us"))
                 .withWatermark("ts", lateness))
        folds = timed.groupBy("user_id").transformWithStateInPandas(ToggleFold(), _FOLD_OUT, "Update", "EventTime")
        latest = _run_updates(folds, "toggle-ordered", ["user_id"], state)
    finally:
        spark.conf.set(provider, before)
    return latest.filter(F.col("state").isNotNull()).select("user_id", "state")


def _run_counts(rows: DataFrame, name: str, keys: list[str], state: str | None = None,
                compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Run a stateless stream and count its rows by ``keys``; returns
    ``(keys, cnt)`` over all batches so far.

    A micro-batch writes its own counts, as ``full=0/epoch=N``: an aggregate
    that spills, where a state store would hold every key in memory.  Every
    ``compact_every`` batches the sums are written as ``full=1/epoch=N``, and
    what the compaction before covered is removed.  A batch that runs again
    replaces its own folders, so no row counts twice."""
    spark = rows.sparkSession
    base = (state or scratch_path(spark, name)).rstrip("/")
    if state:
        filesystem, place = filesystem_for(f"{base}/checkpoint/state")
        if filesystem.get_file_info(place).type.name != "NotFound":
            raise ValueError(f"{base} was written with running totals in a state store; start a new folder")
    out = f"{base}/out"
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("cnt", T.LongType())])

    def write(batch: DataFrame, epoch: int) -> None:
        (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
         .write.mode("overwrite").parquet(f"{out}/full=0/epoch={epoch}"))
        if (epoch + 1) % compact_every == 0:
            _summed(batch.sparkSession, out, schema, keys, epoch).write.mode("overwrite").parquet(
                f"{out}/full=1/epoch={epoch}")
            gone = epoch - compact_every   # the compaction before this one is kept for readers at work
            for old in range(max(0, gone - compact_every + 1), gone + 1):
                remove_tree(f"{out}/full=0/epoch={old}")
            remove_tree(f"{out}/full=1/epoch={gone - compact_every}")

    q = (rows.select(*keys).writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return _summed(spark, out, schema, keys)


def _summed(spark: SparkSession, out: str, schema: T.StructType, keys: list[str], upto: int | None = None) -> DataFrame:
    """Sums of the last compaction and the batches since."""
    parts = T.StructType([*schema.fields, T.StructField("full", T.IntegerType()), T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(parts).parquet(out)
    if upto is not None:
        rows = rows.filter(F.col("epoch") <= upto)
        rows = rows.filter((F.col("full") == 0) | (F.col("epoch") < upto))
    since = rows.filter("full = 1").agg(F.max("epoch")).first()[0]
    if since is not None:
        rows = rows.filter((F.col("epoch") > since) | ((F.col("full") == 1) & (F.col("epoch") == since)))
    if len(rows.select("full", "epoch").distinct().limit(2).collect()) < 2:
        return rows.select(*schema.names)   # one folder has a key once
    return rows.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def stream_ngram_counts(stream: DataFrame, text: str, doc: str, order: int = 2, state: str | None = None,
                        compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Transition counts maintained over a stream of documents; a micro-batch
    writes the counts of the transitions that it met."""
    from ..models.ngram import transitions

    rows = transitions(stream, F.col(text), F.col(doc), order)
    return _run_counts(rows, "ngram", ["state", "next"], state, compact_every)
