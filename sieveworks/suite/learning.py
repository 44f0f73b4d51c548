"""Suite: n-gram, tabular and vector models fitted and scored on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import ngram as N
from ..models import tabular as TB
from ..models import vectors as V
from .common import sql, table
from .registry import register

_TOK = "'[%W%]+|[^%W%%SP%]'"
_NGRAM_BASE = (
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), " + _TOK + ") AS tk FROM documents), "
    "w AS (SELECT doc_id, i, tk[i] || chr(31) || tk[i + 1] AS state, tk[i + 2] AS nxt "
    "FROM (SELECT doc_id, tk, unnest(range(1, len(tk) - 1)) AS i FROM t WHERE len(tk) > 2)), "
    "m AS (SELECT state, nxt, count(*) AS cnt, min(doc_id * 100000000 + i) AS first FROM w GROUP BY state, nxt), "
    "best AS (SELECT state, nxt, cnt FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY cnt DESC, first) "
    "AS rn FROM m) WHERE rn = 1)")


@register("ngram_fit", sql(_NGRAM_BASE + " SELECT state, nxt AS next, cnt FROM m"))
def q_ngram_fit(spark, sf):
    d = table(spark, sf, "documents")
    return N.ngram_fit(d, F.col("text"), F.col("doc_id"), order=2, counts_only=True)


@register("ngram_next", sql(_NGRAM_BASE + " SELECT state, nxt AS next, cnt FROM best"))
def q_ngram_next(spark, sf):
    d = table(spark, sf, "documents")
    return N.ngram_next(N.ngram_fit(d, F.col("text"), F.col("doc_id"), order=2, by_state=True))


_GEN_SQL = sql(
    "WITH RECURSIVE " + _NGRAM_BASE[len("WITH "):] + ", "
    "p AS (SELECT item_id, regexp_extract_all(lower(text), " + _TOK + ") AS tk FROM benchmark), "
    "gen AS (SELECT item_id, 0 AS step, tk[len(tk) - 1] || chr(31) || tk[len(tk)] AS state, "
    "CAST([] AS VARCHAR[]) AS out FROM p WHERE len(tk) >= 2 "
    "UNION ALL SELECT g.item_id, g.step + 1, split_part(g.state, chr(31), 2) || chr(31) || b.nxt, "
    "list_append(g.out, b.nxt) FROM gen g JOIN best b ON b.state = g.state WHERE g.step < 30), "
    "fin AS (SELECT item_id, arg_max(out, step) AS out FROM gen GROUP BY item_id) "
    "SELECT p.item_id, array_to_string(fin.out, ' ') AS text FROM p LEFT JOIN fin USING (item_id)")


@register("ngram_generate", _GEN_SQL)
def q_ngram_generate(spark, sf):
    d = table(spark, sf, "documents")
    best = N.ngram_next(N.ngram_fit(d, F.col("text"), F.col("doc_id"), order=2, by_state=True))
    prompts = table(spark, sf, "benchmark")
    return N.ngram_generate(prompts, "text", "item_id", best, order=2, max_new_tokens=30)


_SAMPLE_SQL = sql(
    "WITH RECURSIVE " + _NGRAM_BASE[len("WITH "):] + ", "
    "c AS (SELECT state, nxt, cnt, sum(cnt) OVER (PARTITION BY state ORDER BY first) AS upto, "
    "sum(cnt) OVER (PARTITION BY state) AS total FROM m), "
    "p AS (SELECT item_id, regexp_extract_all(lower(text), " + _TOK + ") AS tk FROM benchmark), "
    "u AS (SELECT item_id, step, ('0x' || substring(sha256('42:' || item_id || ':' || step), 1, 13))::BIGINT::DOUBLE "
    "/ 4503599627370496.0 AS u FROM p, range(30) t(step)), "
    "gen AS (SELECT item_id, 0 AS step, tk[len(tk) - 1] || chr(31) || tk[len(tk)] AS state, "
    "CAST([] AS VARCHAR[]) AS out FROM p WHERE len(tk) >= 2 "
    "UNION ALL SELECT g.item_id, g.step + 1, split_part(g.state, chr(31), 2) || chr(31) || c.nxt, "
    "list_append(g.out, c.nxt) FROM gen g JOIN u ON u.item_id = g.item_id AND u.step = g.step "
    "JOIN c ON c.state = g.state AND floor(u.u * c.total) < c.upto AND floor(u.u * c.total) >= c.upto - c.cnt "
    "WHERE g.step < 30), "
    "fin AS (SELECT item_id, arg_max(out, step) AS out FROM gen GROUP BY item_id) "
    "SELECT p.item_id, array_to_string(fin.out, ' ') AS text FROM p LEFT JOIN fin USING (item_id)")


@register("ngram_sample", _SAMPLE_SQL)
def q_ngram_sample(spark, sf):
    d = table(spark, sf, "documents")
    model = N.ngram_fit(d, F.col("text"), F.col("doc_id"), order=2, by_state=True)
    return N.ngram_sample(table(spark, sf, "benchmark"), "text", "item_id", model, order=2, max_new_tokens=30,
                          seed=42)


@register("stream_ngram_counts", sql(_NGRAM_BASE + " SELECT state, nxt AS next, cnt FROM m"))
def q_stream_ngram_counts(spark, sf):
    from ..streaming.streams import stream_ngram_counts

    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/documents[.]parquet")
    return stream_ngram_counts(stream, "text", "doc_id")


# --- tabular ------------------------------------------------------------------

_SPLIT_CTE = (
    "b AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, "
    "row_number() OVER () AS ord FROM lineitem), "
    "r AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || rid), rid) AS rn, count(*) OVER () AS n FROM b), "
    "tr AS (SELECT * FROM r WHERE rn > greatest(1, least(n - 2, CAST(round_even(n * 0.2, 0) AS BIGINT))))")

_FEATURES = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def _lineitem_rows(spark, sf):
    from ..plans.ordering import ORDER, with_source_number

    li = with_source_number(table(spark, sf, "lineitem")).drop(ORDER)
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.withColumn("rid", rid)


def _num_sql(c: str) -> str:
    return (f"SELECT '{c}' AS name, 'numeric' AS kind, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, "
            f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale, "
            f"CAST(NULL AS VARCHAR) AS categories FROM tr")


def _cat_sql(c: str) -> str:
    return (f"SELECT '{c}', 'categorical', NULL, NULL, NULL, string_agg(v, '|' ORDER BY n DESC, f) FROM "
            f"(SELECT {c} AS v, count(*) AS n, min(ord) AS f FROM tr GROUP BY 1 ORDER BY n DESC, f LIMIT 50)")


@register("tabular_feature_schema", "WITH " + _SPLIT_CTE + " " + " UNION ALL ".join(
    [_num_sql("l_quantity"), _num_sql("l_discount"), _cat_sql("l_returnflag"), _cat_sql("l_linestatus")]))
def q_tabular_feature_schema(spark, sf):
    from ..plans.ordering import split_train_validation

    rows = _lineitem_rows(spark, sf)
    train = split_train_validation(rows, "rid", 0.2, 42).filter(F.col("split") == "train")
    schema = TB.feature_schema(train, _FEATURES, 50)
    out = [(f.name, f.kind, round(f.median, 6) if f.kind == "numeric" else None,
            round(f.mean, 6) if f.kind == "numeric" else None, round(f.scale, 6) if f.kind == "numeric" else None,
            "|".join(f.categories) if f.kind == "categorical" else None) for f in schema]
    return spark.createDataFrame(out, "name string, kind string, median double, mean double, scale double, "
                                      "categories string")


def _fitted_schema(spark, sf):
    from ..plans.ordering import split_train_validation

    rows = _lineitem_rows(spark, sf)
    split = split_train_validation(rows, "rid", 0.2, 42)
    return rows, TB.feature_schema(split.filter(F.col("split") == "train"), _FEATURES, 50)


@register("tabular_encode", "WITH " + _SPLIT_CTE + ", s AS (SELECT avg(l_quantity) AS mq, "
          "CASE WHEN stddev_pop(l_quantity) = 0 THEN 1 ELSE stddev_pop(l_quantity) END AS sq, avg(l_discount) AS md, "
          "CASE WHEN stddev_pop(l_discount) = 0 THEN 1 ELSE stddev_pop(l_discount) END AS sd FROM tr) "
          "SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS e_quantity, "
          "round((l_discount - md) / sd, 6) AS e_discount, l_returnflag AS hot_returnflag FROM lineitem, s")
def q_tabular_encode(spark, sf):
    rows, schema = _fitted_schema(spark, sf)
    x = TB.encode(rows, schema)
    cats = [f for f in schema if f.kind == "categorical"][0].categories
    hot = F.element_at(F.array(*[F.lit(c) for c in cats] + [F.lit("[OTHER]")]),
                       F.array_position(F.slice(x, 4, len(cats) + 1), 1.0).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", F.round(x[1], 6).alias("e_quantity"),
                       F.round(x[2], 6).alias("e_discount"), hot.alias("hot_returnflag"))


def _encoded_sql(features: list[str], numeric: set[str], target: str) -> str:
    """CTEs up to ``xs`` (lineitem rows, x, y, train): the feature schema of the
    training rows and the encoded rows."""
    ctes, parts = [], ["[1.0]"]
    for i, c in enumerate(features):
        if c in numeric:
            ctes.append(f"f{i} AS (SELECT avg({c}) AS m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END "
                        f"AS s FROM tr)")
            parts.append(f"[({c} - f{i}.m) / f{i}.s]")
        else:
            ctes.append(f"f{i} AS (SELECT list(v ORDER BY n DESC, f) AS cats FROM (SELECT {c} AS v, count(*) AS n, "
                        f"min(ord) AS f FROM tr GROUP BY 1 ORDER BY n DESC, f LIMIT 50))")
            parts.append(f"list_transform(f{i}.cats, lambda q: (q = {c})::INT::DOUBLE)")
            parts.append(f"[(NOT list_contains(f{i}.cats, {c}))::INT::DOUBLE]")
    x = parts[0]
    for part in parts[1:]:
        x = f"list_concat({x}, {part})"
    return (_SPLIT_CTE + ", " + ", ".join(ctes) + f", xs AS (SELECT r.*, {x}::DOUBLE[] AS x, {target} AS y, "
            "rn > greatest(1, least(n - 2, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS train FROM r, "
            + ", ".join(f"f{i}" for i in range(len(features))) + ")")


def _ridge_sql(name: str, rows: str) -> str:
    """CTEs up to ``name`` (w DOUBLE[]): the normal equations of ``rows``,
    solved by elimination."""
    return (f"{name}_d AS (SELECT max(len(x)) AS d FROM xs), "
            f"{name}_g AS (SELECT i, j, sum(x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 0.001 ELSE 0 END AS v "
            f"FROM {rows}, {name}_d, range(1, d + 1) a(i), range(1, d + 1) b(j) GROUP BY i, j), "
            f"{name}_b AS (SELECT i, sum(x[i] * y) AS v FROM {rows}, {name}_d, range(1, d + 1) a(i) GROUP BY i), "
            f"{name}_r AS (SELECT g.i, list_append(list(g.v ORDER BY j), any_value(b.v)) AS r "
            f"FROM {name}_g g JOIN {name}_b b ON b.i = g.i GROUP BY g.i), "
            f"{name}_e AS (SELECT 1 AS k, list(r ORDER BY i) AS m FROM {name}_r UNION ALL SELECT k + 1, "
            f"list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) "
            f"ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM {name}_e WHERE k <= len(m)), "
            f"{name} AS (SELECT list_transform(m, lambda r: r[len(r)]) AS w FROM {name}_e ORDER BY k DESC LIMIT 1)")


_NUMERIC = {"l_quantity", "l_discount", "l_tax"}
_RIDGE = "WITH RECURSIVE " + _encoded_sql(_FEATURES, _NUMERIC, "l_extendedprice") + ", " + _ridge_sql("w", "xs")


@register("ridge_fit", _RIDGE + " SELECT (i - 1)::INT AS idx, round(w[i], 1) + 0.0::DOUBLE AS weight FROM w, "
                                "range(1, len(w) + 1) t(i)")
def q_ridge_fit(spark, sf):
    rows = _lineitem_rows(spark, sf)
    model = TB.fit_tabular(rows, _FEATURES, "l_extendedprice", "regression", id_col="rid")
    # the flags of a column add up to the intercept: only the penalty fixes their level, to a few digits
    return spark.createDataFrame([(i, round(w, 1) + 0.0) for i, w in enumerate(model["weights"])], "idx int, weight double")


_ONE_FEATURE = ("WITH " + _SPLIT_CTE + ", s AS (SELECT avg(l_quantity) AS m, CASE WHEN stddev_pop(l_quantity) = 0 THEN 1 "
                "ELSE stddev_pop(l_quantity) END AS s FROM tr), z AS (SELECT (l_quantity - m) / s AS z, l_extendedprice "
                "AS y, lineitem.* FROM lineitem, s), g AS (SELECT count(*)::DOUBLE AS n, sum(z) AS sz, sum(z * z) + 0.001 "
                "AS szz, sum(y) AS sy, sum(z * y) AS szy FROM z), w AS (SELECT (sy * szz - sz * szy) / (n * szz - sz * sz) "
                "AS w0, (n * szy - sz * sy) / (n * szz - sz * sz) AS w1 FROM g) ")


def _one_feature(spark, sf):
    return TB.fit_tabular(_lineitem_rows(spark, sf), ["l_quantity"], "l_extendedprice", "regression", id_col="rid")


@register("ridge_fit_one_feature", _ONE_FEATURE + "SELECT CAST(0 AS INTEGER) AS idx, round(w0, 4) AS weight FROM w "
          "UNION ALL SELECT 1, round(w1, 4) FROM w")
def q_ridge_fit_one_feature(spark, sf):
    """The ridge system of one standardised feature, solved in SQL as well."""
    weights = _one_feature(spark, sf)["weights"]
    return spark.createDataFrame([(i, round(w, 4)) for i, w in enumerate(weights)], "idx int, weight double")


@register("tabular_predict_one_feature", _ONE_FEATURE + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "round(w0 + w1 * z, 3) AS prediction FROM z, w")
def q_tabular_predict_one_feature(spark, sf):
    model = _one_feature(spark, sf)
    rows = _lineitem_rows(spark, sf)
    x = TB.encode(rows, [TB.Feature(**f) for f in model["features"]])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(
        TB.predict_regression(x, __import__("numpy").array(model["weights"])), 3).alias("prediction"))


_LOG_FIT = ("WITH RECURSIVE " + _encoded_sql(_FEATURES, _NUMERIC, "ln(1 + l_extendedprice)") + ", " +
            _ridge_sql("w", "(SELECT * FROM xs WHERE train)") +
            ", p AS (SELECT len(w) AS d, l_extendedprice AS truth, exp(list_inner_product(x, w)) - 1 AS pred FROM xs, w "
            "WHERE NOT train)")


@register("tabular_fit", _LOG_FIT + " SELECT max(d)::INT AS dimensions, round(avg(abs(pred - truth)), 3) AS mae, "
          "round(sqrt(avg((pred - truth) ^ 2)), 3) AS rmse, "
          "round(1 - sum((pred - truth) ^ 2) / (var_pop(truth) * count(*)), 6) AS r2 FROM p")
def q_tabular_fit(spark, sf):
    rows = _lineitem_rows(spark, sf)
    model = TB.fit_tabular(rows, _FEATURES, "l_extendedprice", "regression", id_col="rid",
                           target_transform="log1p")
    m = model["metrics"]
    return spark.createDataFrame([(model["dimensions"], round(m["mae"], 3), round(m["rmse"], 3), round(m["r2"], 6))],
                                 "dimensions int, mae double, rmse double, r2 double")


@register("tabular_predict", _RIDGE + " SELECT l_orderkey, l_linenumber, round(list_inner_product(x, w), 3) AS prediction "
                                      "FROM xs, w")
def q_tabular_predict(spark, sf):
    rows = _lineitem_rows(spark, sf)
    model = TB.fit_tabular(rows, _FEATURES, "l_extendedprice", "regression", id_col="rid")
    x = TB.encode(rows, [TB.Feature(**f) for f in model["features"]])
    return rows.select("l_orderkey", "l_linenumber",
                       F.round(TB.predict_regression(x, __import__("numpy").array(model["weights"])), 3)
                       .alias("prediction"))


_CLASS_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


def _descent_sql(name: str, rows: str, steps: int, rate: float = 0.05, penalty: float = 0.001) -> str:
    """CTEs up to ``name`` (w DOUBLE[][], one list per class): the first steps of
    full-batch softmax descent from zero weights."""
    ctes = [f"{name}_l AS (SELECT list(DISTINCT y ORDER BY y) AS labels, max(len(x)) AS d FROM xs)",
            f"{name}_0 AS (SELECT list_transform(labels, lambda q: list_resize([]::DOUBLE[], d, 0.0)) AS w FROM {name}_l)"]
    for t in range(steps):
        old, new = f"{name}_{t}", f"{name}_{t + 1}"
        ctes.append(f"{new}_s AS (SELECT x, y, list_transform(w, lambda v: list_inner_product(v, x)) AS s "
                    f"FROM {rows}, {old})")
        ctes.append(f"{new}_p AS (SELECT x, y, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM {new}_s)")
        ctes.append(f"{new}_g AS (SELECT c, i, avg(x[i] * (e[c] / list_sum(e) - (labels[c] = y)::INT)) AS g "
                    f"FROM {new}_p, {name}_l, range(1, len(labels) + 1) a(c), range(1, d + 1) b(i) GROUP BY c, i)")
        ctes.append(f"{new} AS (SELECT list(v ORDER BY c) AS w FROM (SELECT c, list(w[c][i] - {rate} * (g + "
                    f"CASE WHEN i > 1 THEN {penalty} * w[c][i] ELSE 0 END) ORDER BY i) AS v FROM {new}_g, {old} GROUP BY c))")
    return ", ".join(ctes) + f", {name} AS (SELECT w, labels FROM {name}_{steps}, {name}_l)"


_FIRST_STEPS = ("WITH " + _encoded_sql(_CLASS_FEATURES, _NUMERIC, "l_returnflag") + ", " +
                _descent_sql("w", "xs", 3))


def _first_steps(spark, sf):
    return TB.fit_tabular(_lineitem_rows(spark, sf), _CLASS_FEATURES, "l_returnflag", "classification", id_col="rid",
                          iterations=3)


@register("softmax_first_steps", _FIRST_STEPS + " SELECT labels[c] AS label, (i - 1)::INT AS idx, round(w[c][i], 9) AS "
          "weight FROM w, range(1, len(labels) + 1) a(c), range(1, len(w[1]) + 1) b(i)")
def q_softmax_first_steps(spark, sf):
    """The weights after three steps of the descent that ``softmax_fit`` runs to
    its end."""
    model = _first_steps(spark, sf)
    rows = [(label, i, round(float(row[c]), 9)) for c, label in enumerate(model["labels"])
            for i, row in enumerate(model["weights"])]
    return spark.createDataFrame(rows, "label string, idx int, weight double")


@register("tabular_classify_first_steps", _FIRST_STEPS + ", s AS (SELECT l_orderkey, l_linenumber, labels, "
          "list_transform(w, lambda v: list_inner_product(v, x)) AS s FROM xs, w), p AS (SELECT *, "
          "list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM s) SELECT l_orderkey, l_linenumber, "
          "labels[list_position(e, list_max(e))] AS label, round(list_max(e) / list_sum(e), 6) AS score FROM p")
def q_tabular_classify_first_steps(spark, sf):
    model = _first_steps(spark, sf)
    rows = _lineitem_rows(spark, sf)
    x = TB.encode(rows, [TB.Feature(**f) for f in model["features"]])
    ranked = TB.classify(x, __import__("numpy").array(model["weights"]), model["labels"])
    return rows.select("l_orderkey", "l_linenumber", ranked[0]["label"].alias("label"),
                       F.round(ranked[0]["score"], 6).alias("score"))


@register("softmax_fit")
def q_softmax_fit(spark, sf):
    rows = _lineitem_rows(spark, sf)
    model = TB.fit_tabular(rows, ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_returnflag",
                           "classification", id_col="rid")
    return spark.createDataFrame([(lab, float(model["metrics"]["accuracy"])) for lab in model["labels"]],
                                 "label string, validation_accuracy double")


@register("tabular_classify")
def q_tabular_classify(spark, sf):
    import numpy as np

    rows = _lineitem_rows(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]
    model = TB.fit_tabular(rows, feats, "l_returnflag", "classification", id_col="rid")
    schema = [TB.Feature(**f) for f in model["features"]]
    ranked = TB.classify(TB.encode(rows, schema), np.array(model["weights"]), model["labels"])
    return rows.select("l_orderkey", "l_linenumber", ranked[0]["label"].alias("label"),
                       F.round(ranked[0]["score"], 6).alias("score"))


@register("regression_metrics", "WITH p AS (SELECT o.o_orderkey, o.o_totalprice AS truth, "
          "sum(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)) AS pred FROM orders o JOIN lineitem l "
          "ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_totalprice) "
          "SELECT round(avg(abs(pred - truth)), 4) AS mae, round(sqrt(avg((pred - truth) ^ 2)), 4) AS rmse, "
          "round(CASE WHEN var_pop(truth) = 0 THEN 0 ELSE 1 - sum((pred - truth) ^ 2) / (var_pop(truth) * count(*)) "
          "END, 6) AS r2 FROM p")
def q_regression_metrics(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    pred = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"))
    j = o.join(pred, o.o_orderkey == pred.l_orderkey).select("pred", F.col("o_totalprice").alias("truth"))
    m = TB.regression_metrics(j, "pred", "truth")
    return m.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


# --- vectors --------------------------------------------------------------------

@register("vector_check", "SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS classes, min(n) AS smallest_class, "
          "sum(n) >= 4 AND count(*) >= 2 AND min(n) >= 2 AS ok FROM (SELECT label, count(*) AS n FROM embeddings "
          "GROUP BY label)")
def q_vector_check(spark, sf):
    return V.vector_check(table(spark, sf, "embeddings"), "label")


_CENTROID_CTE = ("e AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i "
                 "FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i)")


@register("centroid_fit", "WITH " + _CENTROID_CTE + " SELECT label, CAST(i AS INTEGER) AS dim, round(m, 6) AS value "
                          "FROM c")
def q_centroid_fit(spark, sf):
    c = V.centroid_fit(table(spark, sf, "embeddings"), "embedding", "label")
    return c.select("label", "dim", F.round("value", 6).alias("value"))


_CLASSIFY_SQL = ("WITH " + _CENTROID_CTE + ", d AS (SELECT e.vec_id, c.label AS cl, -avg((c.m - e.v) ^ 2) AS s "
                 "FROM e JOIN c USING (i) GROUP BY e.vec_id, c.label), "
                 "top AS (SELECT vec_id, arg_max(cl, s) AS predicted, "
                 "1 / sum(exp(s - max_s)) AS score FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS max_s FROM d) "
                 "GROUP BY vec_id) ")


@register("centroid_classify", _CLASSIFY_SQL + "SELECT vec_id, CAST(predicted AS VARCHAR) AS predicted, "
          "round(score, 6) AS score FROM top")
def q_centroid_classify(spark, sf):
    emb = table(spark, sf, "embeddings")
    cents = V.centroids_as_arrays(V.centroid_fit(emb, "embedding", "label"))
    out = V.centroid_classify(emb, "embedding", cents, top_k=3)
    return out.select("vec_id", F.col("predictions")[0]["label"].alias("predicted"),
                      F.round(F.col("predictions")[0]["score"], 6).alias("score"))


@register("accuracy", _CLASSIFY_SQL + "SELECT round(avg(CASE WHEN top.predicted = em.label THEN 1.0 ELSE 0.0 END), 6) "
          "AS accuracy, count(*) AS n FROM top JOIN embeddings em USING (vec_id)")
def q_accuracy(spark, sf):
    emb = table(spark, sf, "embeddings")
    cents = V.centroids_as_arrays(V.centroid_fit(emb, "embedding", "label"))
    out = V.centroid_classify(emb, "embedding", cents, top_k=1)
    pred = out.select(F.col("predictions")[0]["label"].alias("p"), F.col("label").cast("string").alias("t"))
    return TB.accuracy(pred, "p", "t").select(F.round("accuracy", 6).alias("accuracy"), "n")


@register("top_k_ranked", _CLASSIFY_SQL.replace("top AS (", "unused AS (") + ", r AS (SELECT vec_id, cl, s, "
          "row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cl) AS rk FROM d) "
          "SELECT vec_id, string_agg(CAST(cl AS VARCHAR), ',' ORDER BY rk) AS labels FROM r WHERE rk <= 3 "
          "GROUP BY vec_id")
def q_top_k_ranked(spark, sf):
    emb = table(spark, sf, "embeddings")
    cents = V.centroids_as_arrays(V.centroid_fit(emb, "embedding", "label"))
    out = V.centroid_classify(emb, "embedding", cents, top_k=3)
    return out.select("vec_id", F.array_join(F.transform("predictions", lambda p: p["label"]), ",").alias("labels"))


@register("linear_softmax_fit")
def q_linear_softmax_fit(spark, sf):
    emb = table(spark, sf, "embeddings")
    labels, w, b = V.linear_softmax_fit(emb, "embedding", "label")
    return spark.createDataFrame([(lab, float(b[i]), float(abs(w[i]).sum())) for i, lab in enumerate(labels)],
                                 "label string, intercept double, weight_l1 double")


@register("linear_softmax_calibration", "SELECT CAST(label AS VARCHAR) AS label, round(count(*) / sum(count(*)) OVER (), 3) "
          "AS mean_probability FROM embeddings GROUP BY label")
def q_linear_softmax_calibration(spark, sf):
    """At the optimum the mean predicted probability of a class is its share of
    the rows, whatever the penalty, because intercepts are not penalised."""
    emb = table(spark, sf, "embeddings")
    labels, w, b = V.linear_softmax_fit(emb, "embedding", "label")
    scores = V.linear_scores(F.col("embedding").cast("array<double>"), labels, w, b)
    every = emb.select(F.explode(V.softmax_top_k(scores, len(labels))).alias("p"))
    return every.groupBy(F.col("p.label").alias("label")).agg(F.round(
        F.sum("p.score") / F.lit(emb.count()), 3).alias("mean_probability"))


@register("linear_softmax_classify")
def q_linear_softmax_classify(spark, sf):
    emb = table(spark, sf, "embeddings")
    labels, w, b = V.linear_softmax_fit(emb, "embedding", "label")
    scores = V.linear_scores(F.col("embedding").cast("array<double>"), labels, w, b)
    top = V.softmax_top_k(scores, 3)
    return emb.select("vec_id", top[0]["label"].alias("predicted"), F.round(top[0]["score"], 4).alias("score"))


@register("linear_softmax_gradient", "SELECT CAST(label AS VARCHAR) AS label, CAST(0 AS DOUBLE) AS largest_gradient "
          "FROM embeddings GROUP BY label")
def q_linear_softmax_gradient(spark, sf):
    """The fit's proof: at its weights no derivative of the penalised loss over
    the whole table is left."""
    emb = table(spark, sf, "embeddings")
    labels, w, b = V.linear_softmax_fit(emb, "embedding", "label")
    gradient = V.linear_softmax_gradient(emb, "embedding", "label", labels, w, b)
    return spark.createDataFrame([(name, round(float(abs(g).max()), 3)) for name, g in zip(labels, gradient)],
                                 "label string, largest_gradient double")
