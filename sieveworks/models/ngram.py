"""Token n-gram model: fit, best next token, generation and sampling.

Fit is one narrow projection (tokenise + enumerate windows inside each row,
no shuffle) followed by one hash aggregate on (state, next) — partial
aggregation collapses frequent transitions before the shuffle.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pyregex as R
from ..functions.text import tokenize_regex

if TYPE_CHECKING:
    import pyarrow as pa

SEP = "\u001f"  # state tokens are joined with the unit separator


def tokens(text: Column, pattern: str = R.TOKEN_PY, lowercase: bool = True) -> Column:
    return tokenize_regex(text, pattern, lowercase)


def transitions(df: DataFrame, text: Column, doc: Column, order: int = 2, pattern: str = R.TOKEN_PY,
                lowercase: bool = True) -> DataFrame:
    """One row per (doc, position, state, next) window.

    The windows are ``order + 1`` shifted copies of the token array zipped
    together (``arrays_zip`` + ``posexplode``), all native expressions."""
    if not 1 <= order <= 8:
        raise ValueError("order must be between 1 and 8")
    t = tokens(text, pattern, lowercase)
    # no filter on size(t): a filter would be pushed below the projection and
    # tokenise every text twice; a null array simply explodes to no rows
    with_t = df.select(doc.alias("doc"), t.alias("t"))
    n = F.size("t") - order
    shifted = [F.slice("t", k + 1, n).alias(f"s{k}") for k in range(order + 1)]
    zipped = F.when(F.size("t") > order, F.arrays_zip(*shifted))
    w = with_t.select("doc", F.posexplode(zipped).alias("pos", "z"))
    state = F.concat_ws(SEP, *[F.col(f"z.s{k}") for k in range(order)])
    return w.select("doc", "pos", state.alias("state"), F.col(f"z.s{order}").alias("next"))


_POS_BITS = 32  # a Spark string holds < 2^31 characters, so positions fit


COMBINED_ROWS = 2 ** 20        # windows that a task counts together before they are shuffled by state
COMBINED_BYTES = 64 * 1024 ** 2


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal windows of a run of batches become one row, so that a frequent
    transition reaches its state's task once a run."""
    import pyarrow as pa

    def counted(held: list) -> list:
        if "first" not in held[0].schema.names:   # sorted, as equal beginnings compress in the shuffle
            got = pa.Table.from_batches(held).group_by(["state", "next"]).aggregate([([], "count_all")])
            got = got.select(["state", "next", "count_all"]).rename_columns(["state", "next", "cnt"])
            return got.sort_by([("state", "ascending"), ("next", "ascending")]).to_batches()
        got = pa.Table.from_batches(held).group_by(["state", "next"]).aggregate([([], "count_all"), ("first", "min")])
        return got.select(["state", "next", "count_all", "first_min"]).rename_columns(
            ["state", "next", "cnt", "first"]).to_batches()

    held: list = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= COMBINED_ROWS or size >= COMBINED_BYTES:
            yield from counted(held)
            held, rows, size = [], 0, 0
    if held:
        yield from counted(held)


def ngram_fit(df: DataFrame, text: Column, doc: Column, order: int = 2, pattern: str = R.TOKEN_PY,
              lowercase: bool = True, by_state: bool = False, counts_only: bool = False) -> DataFrame:
    """``(state, next, cnt, first_doc, first_pos)``.

    First occurrence is the minimum of the exact composite
    ``doc · 2^32 + pos``: a fixed-width mutable buffer, so the aggregate stays a
    hash aggregate with map-side partial aggregation (a struct minimum would
    force a sort-based aggregate).  The composite is a long where all document
    numbers are below 2^31, which one look at that column tells, and a much
    slower ``decimal(38,0)`` with the same result where they are not.

    ``by_state`` gives the same rows dealt out by state: what then looks at
    whole states (``ngram_next``) shuffles nothing again.  Spark would deal the
    aggregate's partial rows out by state and token, so equal windows are
    counted in Arrow batches before the one shuffle.  ``counts_only`` does the
    same without the first occurrences: the runs are bounded, where a partial
    aggregate over a whole split spills."""
    w = transitions(df, text, doc, order, pattern, lowercase)
    if counts_only:
        return (w.select("state", "next").mapInArrow(_combined, "state string, next string, cnt long")
                .repartition("state").groupBy("state", "next").agg(F.sum("cnt").alias("cnt")))
    ends = df.agg(F.min(doc).cast("decimal(38,0)"), F.max(doc).cast("decimal(38,0)")).first()
    if ends[0] is None or (ends[0] >= 0 and ends[1] < 2 ** 31):
        composite = F.shiftleft(F.col("doc").cast("long"), _POS_BITS) + F.col("pos")
        of_doc, of_pos = F.shiftright("first", _POS_BITS), F.col("first").bitwiseAND(F.lit(2 ** _POS_BITS - 1))
    else:
        span = F.lit(2 ** _POS_BITS)
        composite = (F.col("doc").cast("decimal(38,0)") * span + F.col("pos")).cast("decimal(38,0)")
        of_doc, of_pos = F.floor(F.col("first") / span), F.col("first") % span
    if by_state:
        rows = w.select("state", "next", composite.alias("first"))
        kind = rows.schema["first"].dataType.simpleString()
        agg = (rows.mapInArrow(_combined, f"state string, next string, cnt long, first {kind}").repartition("state")
               .groupBy("state", "next").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first")))
    else:
        agg = w.groupBy("state", "next").agg(F.count(F.lit(1)).alias("cnt"), F.min(composite).alias("first"))
    return agg.select("state", "next", "cnt", of_doc.cast("long").alias("first_doc"), of_pos.cast("int").alias("first_pos"))


def ngram_next(model: DataFrame) -> DataFrame:
    """Most frequent next token per state; ties go to the transition seen first.
    One maximum over a struct that carries the token: half the time of a
    ``max_by`` beside a maximum."""
    best = F.struct("cnt", (-F.col("first_doc")).alias("d"), (-F.col("first_pos")).alias("p"), "next")
    return model.groupBy("state").agg(F.max(best).alias("b")).select("state", "b.next", "b.cnt")


def prompt_state(prompt: Column, order: int, pattern: str = R.TOKEN_PY, lowercase: bool = True) -> Column:
    t = tokens(prompt, pattern, lowercase)
    return F.when(F.size(t) >= order, F.array_join(F.slice(t, -order, order), SEP))


MAX_BROADCAST_BYTES = 8 * 1024 ** 2  # of states and tokens that a broadcast may carry; the driver holds many times that
LOOKED_UP = 1024                     # distinct states that one look into a stored table may ask for


def _place(state: Column, parts: int) -> Column:
    return F.pmod(F.hash(state), F.lit(parts))


PLACES = 1024   # folders of a table stored by state, at least


def stored_by_state(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` written in folders by a hash of the state, and their number,
    for ``looked_up``.  The number is a multiple of the shuffle partitions, so
    that a task of a table dealt out by state has all rows of its folders."""
    from ..session import scratch_path

    spark = table.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = shuffled * -(-PLACES // shuffled)
    placed = table.withColumn("__sw_p", _place(F.col("state"), parts))
    path = scratch_path(spark, "ngram-by-state")
    placed.sortWithinPartitions("__sw_p").write.partitionBy("__sw_p").parquet(path)
    return spark.read.schema(placed.schema).parquet(path), parts


def looked_up(stored: DataFrame, states: list[tuple[int, str]]) -> DataFrame:
    """The rows of the ``(folder, state)`` pairs; no other folder is read."""
    if not states:
        return stored.limit(0).drop("__sw_p")
    return stored.filter(F.col("__sw_p").isin(sorted({p for p, _ in states}))
                         & F.col("state").isin([s for _, s in states])).drop("__sw_p")


def few_states(cur: DataFrame, state: str, parts: int, most: int) -> list[tuple[int, str]] | None:
    """The distinct states of ``cur`` with their folders, or None when there
    are more than ``most``."""
    rows = (cur.filter(F.col(state).isNotNull()).select(_place(F.col(state), parts).alias("p"), F.col(state).alias("s"))
            .distinct().limit(most + 1).collect())
    return [(r["p"], r["s"]) for r in rows] if len(rows) <= most else None


def reachable(stored: DataFrame, parts: int, starts: list[tuple[int, str]], order: int, steps: int,
              most: int) -> DataFrame | None:
    """The part of a stored best-next table that walks of ``steps`` steps from
    ``starts`` can use: one look a step at the states that are new, none once
    all walks have met known ones.  It holds at most ``most`` states a step;
    None when a step would ask for more."""
    shifted = F.array_join(F.slice(F.concat(F.split("state", SEP, -1), F.array("next")), 2, order), SEP)
    seen, rows, asked = set(), [], starts
    for _ in range(steps):
        asked = [x for x in asked if x not in seen]
        if not asked:
            break
        if len(asked) > most:
            return None
        seen.update(asked)
        found = looked_up(stored, asked).select("state", "next", "cnt", _place(shifted, parts).alias("p"),
                                                shifted.alias("s")).collect()
        rows += [(r["state"], r["next"], r["cnt"]) for r in found]
        asked = list({(r["p"], r["s"]) for r in found})
    return stored.sparkSession.createDataFrame(rows, "state string, next string, cnt long")


def _text_bytes(table: DataFrame) -> int:
    return table.agg(F.sum(F.octet_length("state") + F.octet_length("next"))).first()[0] or 0


def _sent_whole(table: DataFrame, size: Column, most: int) -> DataFrame:
    """``table`` marked for broadcast when its counted bytes stay within the
    bound; beyond it both sides of a join are shuffled, with the same result."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= most else table


def single_jumps(best: DataFrame, order: int) -> DataFrame:
    """The best-next table as a function on states, ``(__sw_s, __sw_to,
    __sw_words)``: the state that a step leads to and its token."""
    from ..session import materialize

    shifted = F.array_join(F.slice(F.concat(F.split("state", SEP, -1), F.array("next")), 2, order), SEP)
    return materialize(best.select(F.col("state").alias("__sw_s"), shifted.alias("__sw_to"),
                                   F.col("next").alias("__sw_words")), "ngram-jumps")


def doubled_jumps(table: DataFrame) -> DataFrame:
    """Jumps twice as long: each one followed by the jump from where it ended.
    One that meets a state without successor ends there, with a null target."""
    from ..session import materialize

    onward = table.select(F.col("__sw_s").alias("__sw_s2"), F.col("__sw_to").alias("__sw_to2"),
                          F.col("__sw_words").alias("__sw_words2"))
    ended = F.concat(F.lit(SEP), F.col("__sw_s"))   # no state starts with the separator
    both = table.join(onward, F.coalesce("__sw_to", ended) == F.col("__sw_s2"), "left")
    return materialize(both.select("__sw_s", F.col("__sw_to2").alias("__sw_to"),
                                   F.concat_ws(" ", "__sw_words", "__sw_words2").alias("__sw_words")), "ngram-jumps")


def reached_jumps(table: DataFrame) -> DataFrame:
    """The jumps from states that some jump leads to.  Whoever has taken a jump
    needs no others, and their targets are among them, so the table shrinks
    towards the cycles that all walks end in."""
    from ..session import materialize

    reached = table.select(F.col("__sw_to").alias("__sw_at")).filter("__sw_at IS NOT NULL").distinct()
    return materialize(table.join(reached, F.col("__sw_s") == F.col("__sw_at"), "left_semi"), "ngram-jumps")


def ngram_generate(prompts: DataFrame, prompt: str, key: str, best: DataFrame, order: int = 2,
                   max_new_tokens: int = 30, pattern: str = R.TOKEN_PY, lowercase: bool = True,
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES, most_looked_up: int = LOOKED_UP) -> DataFrame:
    """Greedy generation for every prompt: ``(key, text)``; prompts shorter
    than ``order`` tokens give a null text (the reference rejects them).

    The best-next table is written once.  Where it is too large to broadcast
    and the prompts stand at no more than ``most_looked_up`` states, it is first
    cut to the states that their walks can reach (``reachable``).

    Pointer doubling: the prompts take one step, and then, for each binary
    digit of the steps that are left, one jump of that many.  Jump tables are
    doubled by a self-join, kept to the states that the prompts can stand at,
    and written, so that the plan holds one join per jump that the prompts take.
    A table is broadcast only when its counted bytes are at most
    ``max_broadcast_bytes``; otherwise both sides are hash-partitioned.  A
    prompt whose state has no successor keeps a null state and stops growing;
    null states are spread by the prompt's key, so that finished prompts do
    not meet in one partition."""
    cur = prompts.select(F.col(key).alias("__sw_k"), prompt_state(F.col(prompt), order, pattern, lowercase)
                         .alias("__sw_state"), F.lit("").alias("__sw_out"),
                         F.size(tokens(F.col(prompt), pattern, lowercase)).alias("__sw_ntok"))

    def moved(cur: DataFrame, table: DataFrame) -> DataFrame:
        size = F.octet_length("__sw_s") + F.octet_length("__sw_words") + F.coalesce(F.octet_length("__sw_to"), F.lit(0))
        table = _sent_whole(table, size, max_broadcast_bytes)
        j = cur.join(table, _spread_null(cur) == table["__sw_s"], "left")
        words = F.concat_ws(" ", F.nullif("__sw_out", F.lit("")), "__sw_words")
        return j.select("__sw_k", F.col("__sw_to").alias("__sw_state"), words.alias("__sw_out"), "__sw_ntok")

    if max_new_tokens > 0:
        best, parts = stored_by_state(best.select("state", "next", "cnt"))
        if _text_bytes(best) > max_broadcast_bytes:
            starts = few_states(cur, "__sw_state", parts, most_looked_up)
            near = None if starts is None else reachable(best, parts, starts, order, max_new_tokens, most_looked_up)
            best = best if near is None else near
        table = single_jumps(best, order)
        cur, left = moved(cur, table), max_new_tokens - 1
        while left:
            table = reached_jumps(table)
            while not left & 1:
                table, left = doubled_jumps(table), left >> 1
            cur, left = moved(cur, table), left - 1
    return cur.select(F.col("__sw_k").alias(key), F.when(F.col("__sw_ntok") >= order, F.col("__sw_out")).alias("text"))


def _spread_null(cur: DataFrame) -> Column:
    """The state, or for finished prompts a text that no state equals (states
    never start with the separator)."""
    return F.coalesce(cur["__sw_state"], F.concat(F.lit(SEP), F.xxhash64(cur["__sw_k"]).cast("string")))


def uniform(seed: int, key: Column, step: Column) -> Column:
    """Deterministic uniform [0, 1) from ``sha2(seed:key:step)`` (52 bits)."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), step.cast("string")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(2 ** 52)


INLINE_SUCCESSORS = 1024   # a state with more is split into buckets
BUCKETS = 4096             # of a state at most
LONGER_LISTS = 64          # times as many successors may stand in one row where only a step's states are prepared


def ngram_sample_tables(model: DataFrame, inline: int = INLINE_SUCCESSORS) -> tuple[DataFrame, DataFrame]:
    """``(states, buckets)`` for weighted draws; options stand in the order in
    which they were first seen.

    ``states`` has one row per state: the total and the (next, cnt) options of a
    state with at most ``inline`` successors, or the (bucket, cnt) totals of one
    with more.  ``buckets`` has the options of the latter, one row per (state,
    bucket): consecutive successors, ``inline`` of them or a 4096th of all.
    Only successors of such states are ranked, by one range shuffle of them
    all, so a hot state is never in one row, one window or one task.  ``model``
    is read several times."""
    from ..plans.ordering import with_global_position
    from ..session import materialize

    per = materialize(model.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total")), "ngram-totals")
    hot = per.filter(F.col("n") > inline).select(F.col("state").alias("hot"), "n", "total")
    known = model.select("state", "next", "cnt", "first_doc", "first_pos")
    option = F.struct("first_doc", "first_pos", "next", "cnt")
    options = F.transform(F.array_sort(F.collect_list(option)), lambda x: F.struct(x["next"], x["cnt"]))
    split = not hot.isEmpty()
    rest = known.join(hot, F.col("state") == F.col("hot"), "left_anti") if split else known
    whole = (rest.groupBy("state")
             .agg(F.sum("cnt").alias("total"), options.alias("options")).withColumn("whole", F.lit(True)))
    if not split:
        return whole, known.select("state", F.lit("").alias("bucket"), F.array(F.struct("next", "cnt")).alias("options")).limit(0)

    large = known.join(hot, F.col("state") == F.col("hot"), "left_semi")
    placed = with_global_position(large, [F.col(c) for c in ("state", "first_doc", "first_pos")], "place")
    first = placed.groupBy(F.col("state").alias("hot")).agg(F.min("place").alias("start"))
    spans = hot.withColumnRenamed("hot", "state").join(first, F.col("state") == F.col("hot")).drop("hot")
    size = F.greatest(F.lit(inline), F.ceil(F.col("n") / BUCKETS)).alias("size")
    spans = materialize(spans.select(F.col("state").alias("hot"), "start", "total", size), "ngram-spans")
    bucket = F.floor((F.col("place") - F.col("start")) / F.col("size")).cast("string")
    buckets = materialize(placed.join(spans, F.col("state") == F.col("hot")).withColumn("bucket", bucket)
                          .groupBy("state", "bucket").agg(F.sum("cnt").alias("cnt"), options.alias("options")), "ngram-buckets")
    order = F.struct(F.col("bucket").cast("long").alias("at"), F.col("bucket").alias("next"), "cnt")
    totals = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["next"], x["cnt"]))
    split = (buckets.groupBy("state").agg(F.sum("cnt").alias("total"), totals.alias("options"))
             .withColumn("whole", F.lit(False)))
    return whole.unionByName(split), buckets.select("state", "bucket", "options")


def _drawn(options: Column, r: Column) -> Column:
    """The option in whose share ``r`` falls, and what of ``r`` lies in it:
    ``struct(next, rest)``; null when ``r`` lies beyond all of them."""
    start = F.struct(F.lit(None).cast("string").alias("next"), r.cast("long").alias("rest"))

    def step(acc: Column, o: Column) -> Column:
        return (F.when(acc["next"].isNotNull(), acc)
                .when(acc["rest"] < o["cnt"], F.struct(o["next"].alias("next"), acc["rest"].alias("rest")))
                .otherwise(F.struct(F.lit(None).cast("string").alias("next"), (acc["rest"] - o["cnt"]).alias("rest"))))
    return F.aggregate(options, start, step)


STEPS_A_PLAN = 10   # sampling steps before the prompts are written and read again


def _drawing_tables(model: DataFrame, inline: int, max_broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """``ngram_sample_tables`` stored for joins; no buckets where no state has any."""
    from ..session import materialize

    states, buckets = ngram_sample_tables(model, inline)
    states = materialize(states.select(F.col("state").alias("__sw_s"), F.col("total").alias("__sw_t"),
                                       F.col("whole").alias("__sw_w"), F.col("options").alias("__sw_o")), "ngram-states")
    buckets = materialize(buckets.select(F.col("state").alias("__sw_s2"), F.col("bucket").alias("__sw_b"),
                                         F.col("options").alias("__sw_o2")), "ngram-large")
    held = F.aggregate(F.transform("__sw_o", lambda x: F.octet_length(x["next"]) + 12), F.lit(0), lambda a, v: a + v)
    states = _sent_whole(states, F.octet_length("__sw_s") + held, max_broadcast_bytes)
    if buckets.isEmpty():
        return states, None
    held = F.aggregate(F.transform("__sw_o2", lambda x: F.octet_length(x["next"]) + 12), F.lit(0), lambda a, v: a + v)
    return states, _sent_whole(buckets, F.octet_length("__sw_s2") + held, max_broadcast_bytes)


def ngram_sample(prompts: DataFrame, prompt: str, key: str, model: DataFrame, order: int = 2,
                 max_new_tokens: int = 30, seed: int = 42, pattern: str = R.TOKEN_PY, lowercase: bool = True,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES, inline: int = INLINE_SUCCESSORS,
                 most_looked_up: int = LOOKED_UP) -> DataFrame:
    """Count-weighted sampling of the next token: draw ``r = floor(u·total)``
    with ``u = uniform(seed, key, step)`` and take the option whose cumulative
    count exceeds ``r``, first among a state's buckets and then in the bucket
    (see ``ngram_sample_tables``).  Each step joins the prompts to their states
    and, only where some state has buckets, to those.

    The model is written once.  Where it is too large to broadcast and the
    prompts stand at no more than ``most_looked_up`` states, a step reads and
    prepares these states only; else all states are prepared once."""
    from ..session import materialize

    model, parts = stored_by_state(model.select("state", "next", "cnt", "first_doc", "first_pos"))
    large = _text_bytes(model) > max_broadcast_bytes
    every: tuple[DataFrame, DataFrame | None] | None = None
    cur = prompts.select(F.col(key).alias("__sw_k"), prompt_state(F.col(prompt), order, pattern, lowercase)
                         .alias("__sw_state"), F.array().cast("array<string>").alias("__sw_out"),
                         F.size(tokens(F.col(prompt), pattern, lowercase)).alias("__sw_ntok"))
    for step in range(max_new_tokens):
        asked = few_states(cur, "__sw_state", parts, most_looked_up) if large else None
        if asked is not None:
            if not asked:   # every walk has ended
                break
            near = materialize(looked_up(model, asked), "ngram-near")
            states, buckets = _drawing_tables(near, inline * LONGER_LISTS, max_broadcast_bytes)
        else:
            every = every or _drawing_tables(model, inline, max_broadcast_bytes)
            states, buckets = every
        j = cur.join(states, _spread_null(cur) == states["__sw_s"], "left")
        r = F.floor(uniform(seed, F.col("__sw_k"), F.lit(step)) * F.col("__sw_t"))
        j = j.withColumn("__sw_d", F.when(F.col("__sw_s").isNotNull(), _drawn(F.col("__sw_o"), r)))
        tok = F.col("__sw_d.next")
        if buckets is not None:
            # a prompt at a state without buckets looks for none
            place = F.when(~F.col("__sw_w"), F.col("__sw_s"))
            j = j.join(buckets, (F.coalesce(place, F.concat(F.lit(SEP), F.xxhash64("__sw_k").cast("string")))
                                 == buckets["__sw_s2"]) & (F.col("__sw_d.next") == buckets["__sw_b"]), "left")
            tok = F.when(F.col("__sw_w"), tok).otherwise(_drawn(F.col("__sw_o2"), F.col("__sw_d.rest"))["next"])
        j = j.withColumn("__sw_tok", tok)
        nxt_state = F.array_join(F.slice(F.concat(F.split("__sw_state", SEP, -1), F.array("__sw_tok")), 2, order), SEP)
        hit = F.col("__sw_tok").isNotNull()
        cur = j.select("__sw_k", F.when(hit, nxt_state).alias("__sw_state"),
                       F.when(hit, F.concat("__sw_out", F.array("__sw_tok"))).otherwise(F.col("__sw_out"))
                       .alias("__sw_out"), "__sw_ntok")
        if step + 1 < max_new_tokens and (large or (step + 1) % STEPS_A_PLAN == 0):
            cur = materialize(cur, "ngram-drawn")
    return cur.select(F.col("__sw_k").alias(key),
                      F.when(F.col("__sw_ntok") >= order, F.array_join("__sw_out", " ")).alias("text"))
