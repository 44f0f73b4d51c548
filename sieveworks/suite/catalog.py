"""Suite: catalog questions, counts and tensor merges on the TPC-H-like tables.

Mapping used throughout: orders are items (owner ``o_custkey``, public when
``o_orderpriority = '1-URGENT'``, created ``o_orderdate``); lineitem rows are
versions/states of an order (owner ``l_suppkey``, archived when
``l_returnflag = 'R'``, version ``l_linenumber``); parts fork from the part
whose key equals their ``p_size``; events are per-user activity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import catalog as K
from ..plans.merge import signature_compare, weighted_merge
from .common import table
from .registry import register

OWNER = 7


def _visible(spark, sf):
    return K.visible_items(table(spark, sf, "orders"), table(spark, sf, "lineitem"), OWNER, item="o_orderkey",
                           owner_col="o_custkey", public=F.col("o_orderpriority") == "1-URGENT",
                           state_item="l_orderkey", state_owner="l_suppkey", archived=F.col("l_returnflag") == "R")


_VISIBLE_SQL = (f"SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_custkey = {OWNER}) "
                f"AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = {OWNER} "
                f"AND l_returnflag = 'R')")


@register("visible_items", _VISIBLE_SQL)
def q_visible_items(spark, sf):
    return _visible(spark, sf).select("o_orderkey", "o_custkey")


@register("visible_items_public", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_visible_items_public(spark, sf):
    return K.visible_items(table(spark, sf, "orders"), table(spark, sf, "lineitem"), None, item="o_orderkey",
                           owner_col="o_custkey", public=F.col("o_orderpriority") == "1-URGENT",
                           state_item="l_orderkey", state_owner="l_suppkey",
                           archived=F.col("l_returnflag") == "R").select("o_orderkey")


@register("archived_items", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM "
                            f"lineitem WHERE l_suppkey = {OWNER} AND l_returnflag = 'R')")
def q_archived_items(spark, sf):
    return K.archived_items(table(spark, sf, "orders"), table(spark, sf, "lineitem"), OWNER, item="o_orderkey",
                            state_item="l_orderkey", state_owner="l_suppkey",
                            archived=F.col("l_returnflag") == "R").select("o_orderkey", "o_custkey")


@register("latest_per_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER "
                            "(PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) "
                            "WHERE rn = 1")
def q_latest_per_key(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return K.latest_per_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@register("next_version", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY l_orderkey")
def q_next_version(spark, sf):
    return K.next_version(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


_LATEST_BY_PART = ("(SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY "
                   "l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1)")


@register("latest_with_fallback", "SELECT p.p_partkey, CASE WHEN o.l_partkey IS NOT NULL THEN o.l_orderkey ELSE "
          "f.l_orderkey END AS l_orderkey, CASE WHEN o.l_partkey IS NOT NULL THEN o.l_linenumber ELSE f.l_linenumber "
          "END AS l_linenumber, CASE WHEN o.l_partkey IS NOT NULL THEN 'own' WHEN f.l_partkey IS NOT NULL THEN 'fork' "
          f"END AS origin FROM part p LEFT JOIN {_LATEST_BY_PART} o ON o.l_partkey = p.p_partkey "
          f"LEFT JOIN {_LATEST_BY_PART} f ON f.l_partkey = p.p_size")
def q_latest_with_fallback(spark, sf):
    return K.latest_with_fallback(table(spark, sf, "part"), table(spark, sf, "lineitem"), item="p_partkey",
                                  fork_of="p_size", version_item="l_partkey", order=["l_orderkey", "l_linenumber"],
                                  value=["l_orderkey", "l_linenumber"])


@register("validate_inputs", "WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type, "
          "CAST(value AS VARCHAR) AS value FROM events) SELECT event_id, TRY_CAST(k AS BIGINT) AS k, "
          "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS event_type, "
          "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NULL ELSE "
          "'must be one of: click, view, purchase' END AS event_error, "
          "CASE WHEN event_id % 3 = 0 THEN 'is required' END AS note_error, "
          "CASE WHEN event_id % 5 = 0 THEN 'not part of the contract: extra' END AS unknown, "
          "CASE WHEN event_type = 'click' THEN CAST(0.5 AS DOUBLE) END AS rate FROM e")
def q_validate_inputs(spark, sf):
    """Events as submitted inputs: typed members, choices, a required field,
    an unknown name and a field that depends on another."""
    from ..plans.contracts import Field, validate_inputs

    ev = table(spark, sf, "events")
    submitted = F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), F.col("event_type")),
        F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("note"), F.lit("x")))
        .otherwise(F.create_map(F.lit("note"), F.lit(""))),
        F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("extra"), F.lit("1")))
        .otherwise(F.create_map().cast("map<string,string>")))
    contract = [Field("k", "integer"), Field("event_type", choices=["click", "view", "purchase"]),
                Field("note", required=True), Field("rate", "number", default=0.5, depends_on={"event_type": "click"})]
    out = validate_inputs(ev.withColumn("submitted", submitted), "submitted", contract)
    return out.select("event_id", "values.k", "values.event_type", F.col("errors")["event_type"].alias("event_error"),
                      F.col("errors")["note"].alias("note_error"), F.col("errors")["_unknown"].alias("unknown"),
                      "values.rate")


@register("resolve_precedence", "WITH w AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events "
          "GROUP BY user_id) SELECT c.c_custkey, coalesce(nullif(w.v, ''), nullif(n.n_name, ''), "
          "nullif(c.c_mktsegment, ''), 'default') AS value, CASE WHEN nullif(w.v, '') IS NOT NULL THEN 'workspace' "
          "WHEN nullif(n.n_name, '') IS NOT NULL THEN 'publisher' WHEN nullif(c.c_mktsegment, '') IS NOT NULL THEN "
          "'config' ELSE 'default' END AS level FROM customer c LEFT JOIN w ON w.user_id = c.c_custkey "
          "LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def q_resolve_precedence(spark, sf):
    ev = table(spark, sf, "events")
    ws = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("workspace"))
    cust = table(spark, sf, "customer")
    nat = table(spark, sf, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("publisher"))
    base = (cust.join(ws, cust.c_custkey == ws.user_id, "left")
            .join(nat, cust.c_nationkey == nat.n_nationkey, "left")
            .select("c_custkey", "workspace", "publisher", F.col("c_mktsegment").alias("config")))
    return K.resolve_precedence(base, "c_custkey", ["workspace", "publisher", "config"], "default")


@register("runnable_items", "WITH v AS (" + _VISIBLE_SQL + "), l AS (SELECT l_orderkey, l_linestatus FROM "
          "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, "
          "l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1) SELECT o_orderkey FROM v WHERE o_orderkey IN (SELECT l_orderkey FROM l WHERE "
          "l_linestatus = 'F')")
def q_runnable_items(spark, sf):
    return K.runnable_items(_visible(spark, sf), table(spark, sf, "lineitem"), item="o_orderkey",
                            version_item="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"],
                            usable=F.col("l_linestatus") == "F").select("o_orderkey")


@register("recent_distinct", "WITH u AS (SELECT l_partkey, max(l_shipdate) AS last_used FROM lineitem GROUP BY "
          "l_partkey) SELECT p_partkey, row_number() OVER (ORDER BY u.last_used DESC NULLS LAST, p_partkey) AS position "
          "FROM part LEFT JOIN u ON u.l_partkey = p_partkey")
def q_recent_distinct(spark, sf):
    r = K.recent_distinct(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem"),
                          item="p_partkey", use_item="l_partkey", ts="l_shipdate")
    return r.select("p_partkey", "position")


_CLICKS_SQL = ("(SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS v "
               "FROM events WHERE event_type IN ('click', 'view'))")


@register("toggle_state", "WITH c AS " + _CLICKS_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id "
          "ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM c), "
          "last AS (SELECT user_id, v AS lv, n FROM r WHERE rn = 1), "
          "brk AS (SELECT r.user_id, min(r.rn) AS first_other FROM r JOIN last USING (user_id) WHERE r.v <> last.lv "
          "GROUP BY r.user_id) "
          "SELECT last.user_id, last.lv AS state FROM last LEFT JOIN brk USING (user_id) "
          "WHERE (coalesce(brk.first_other - 1, last.n)) % 2 = 1")
def q_toggle_state(spark, sf):
    return K.toggle_state(_clicks(spark, sf), ["user_id"], ["ts", "event_id"], "v")


def _clicks(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    return ev.select("user_id", "ts", "event_id",
                     F.when(F.col("event_type") == "click", "up").otherwise("down").alias("v"))


@register("count_by_key", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS "
          "customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def q_count_by_key(spark, sf):
    keys = table(spark, sf, "nation").select("n_nationkey")
    return K.count_by_key("n_nationkey", {"customers": (table(spark, sf, "customer"), "c_nationkey"),
                                          "suppliers": (table(spark, sf, "supplier"), "s_nationkey")},
                          keys=keys).select("n_nationkey", "customers", "suppliers")


@register("global_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS "
          "lineitem, (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM events WHERE "
          "event_type = 'error') AS failed")
def q_global_counts(spark, sf):
    ev = table(spark, sf, "events")
    return K.global_counts({"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem"),
                            "customer": table(spark, sf, "customer")},
                           {"failed": (ev, F.col("event_type") == "error")})


@register("conditional_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS up, "
          "count(*) FILTER (WHERE event_type = 'view') AS down FROM events GROUP BY user_id")
def q_conditional_counts(spark, sf):
    return K.conditional_counts(table(spark, sf, "events"), "user_id", "event_type", {"up": "click", "down": "view"})


@register("distinct_count", "SELECT l_partkey, count(DISTINCT l_suppkey) AS distinct_count FROM lineitem "
                            "GROUP BY l_partkey")
def q_distinct_count(spark, sf):
    return K.distinct_count(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


# --- tensor tables ----------------------------------------------------------------

def _tensors(spark, sf, reverse: bool = False):
    e = table(spark, sf, "embeddings")
    values = F.reverse("embedding") if reverse else F.col("embedding")
    return e.select(F.concat(F.lit("vec."), F.col("vec_id").cast("string")).alias("name"),
                    F.array(F.size("embedding")).alias("shape"), values.alias("values"))


@register("signature_compare", "SELECT count(*) AS tensors_a, count(*) AS tensors_b, CAST(0 AS BIGINT) AS "
          "missing_in_b, CAST(0 AS BIGINT) AS missing_in_a, CAST(0 AS BIGINT) AS shape_mismatches, count(*) > 0 AS tensor_names, count(*) > 0 AS tensor_shapes, "
          "CASE WHEN count(*) > 0 THEN '' ELSE 'tensor_names,tensor_shapes' END AS blockers FROM embeddings")
def q_signature_compare(spark, sf):
    return signature_compare(_tensors(spark, sf), _tensors(spark, sf, reverse=True))


@register("weighted_merge", "SELECT 'vec.' || CAST(vec_id AS VARCHAR) AS name, CAST(i AS INTEGER) AS idx, "
          "round(CAST(CAST(CAST(embedding[i + 1] AS FLOAT) * CAST(0.25 AS FLOAT) AS FLOAT) + "
          "CAST(CAST(embedding[len(embedding) - i] AS FLOAT) * CAST(0.75 AS FLOAT) AS FLOAT) AS FLOAT), 5) "
          "+ CAST(0.0 AS DOUBLE) AS value "
          "FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def q_weighted_merge(spark, sf):
    m = weighted_merge(_tensors(spark, sf), _tensors(spark, sf, reverse=True), 0.25, 0.75)
    return m.select("name", F.posexplode("values").alias("idx", "v")).select(
        "name", "idx", F.round(F.col("v").cast("double"), 5).alias("value"))
