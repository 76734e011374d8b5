"""Feature-engineering queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import lookup
from ..functions.columns import align_to, drop_strings, split_target
from ..functions.scalar import date_cycles, date_parts
from ..operators import encode, groups, impute, numeric, select
from .base import (
    GAPS_SQL,
    LABELLED_SQL,
    TEST_SQL,
    UNSEEN_SQL,
    is_test,
    labelled_documents,
    orders_with_gaps,
    orders_with_unseen,
    query,
    read,
    rounded,
    union_sql,
)


def _train(df):
    return df.where(~is_test())


# ---- projections -----------------------------------------------------------


@query("fe_split_target", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice FROM orders")
def fe_split_target(spark, sf_dir):
    features, target = split_target(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")
    return lookup.join_on_key(features, target, key="o_orderkey")


@query(
    "fe_align",
    "SELECT o_orderkey, o_totalprice, 0 AS o_priority_nan, o_custkey FROM orders",
)
def fe_align(spark, sf_dir):
    wanted = ["o_orderkey", "o_totalprice", "o_priority_nan", "o_custkey"]
    return align_to(read(spark, sf_dir, "orders"), wanted)


@query("fe_drop_strings", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def fe_drop_strings(spark, sf_dir):
    return drop_strings(read(spark, sf_dir, "orders"))


@query(
    "fe_drop_sparse",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {GAPS_SQL}",
)
def fe_drop_sparse(spark, sf_dir):
    return impute.drop_sparse(orders_with_gaps(spark, sf_dir))


# ---- imputation ------------------------------------------------------------


@query(
    "fe_impute_num",
    f"""SELECT o_orderkey, ROUND(COALESCE(o_totalprice, (SELECT MEDIAN(o_totalprice) FROM {GAPS_SQL} WHERE NOT {TEST_SQL})), 4) AS o_totalprice
  FROM {GAPS_SQL}""",
)
def fe_impute_num(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir).select("o_orderkey", "o_totalprice")
    fitted = impute.fit_imputation(_train(table), ["o_totalprice"])
    return rounded(fitted.transform(table).select("o_orderkey", "o_totalprice"), 4)


@query(
    "fe_missing_flag",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END AS o_totalprice_was_missing FROM {GAPS_SQL}""",
)
def fe_missing_flag(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir)
    fitted = impute.fit_imputation(_train(table), ["o_totalprice", "o_orderpriority"])
    return fitted.transform(table).select("o_orderkey", "o_totalprice_was_missing")


@query(
    "fe_impute_cat",
    f"""SELECT o_orderkey, COALESCE(o_orderpriority, (SELECT o_orderpriority FROM {GAPS_SQL}
    WHERE o_orderpriority IS NOT NULL AND NOT {TEST_SQL}
    GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
  FROM {GAPS_SQL}""",
)
def fe_impute_cat(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    fitted = impute.fit_imputation(_train(table), ["o_orderpriority"], complete_too=True)
    return fitted.transform(table)


@query(
    "fe_impute_unknown",
    "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Unknown' ELSE p_brand END AS p_brand FROM part",
)
def fe_impute_unknown(spark, sf_dir):
    gone = F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("p_brand")
    table = read(spark, sf_dir, "part").select("p_partkey", gone)
    return impute.fit_imputation(table, ["p_brand"]).transform(table)


# ---- dates and numbers -----------------------------------------------------


def _date_sql(c: str) -> str:
    parts = {
        "year": f"YEAR({c})",
        "month": f"MONTH({c})",
        "day": f"DAY({c})",
        "dayofweek": f"ISODOW({c}) - 1",
        "dayofyear": f"DAYOFYEAR({c})",
        "weekofyear": f"WEEKOFYEAR({c})",
        "quarter": f"QUARTER({c})",
    }
    return ", ".join(f"CAST({e} AS INTEGER) AS {c}_{n}" for n, e in parts.items())


@query("fe_datetime", f"SELECT o_orderkey, {_date_sql('o_orderdate')} FROM orders")
def fe_datetime(spark, sf_dir):
    parts = [e.alias(n) for n, e in date_parts("o_orderdate").items()]
    return read(spark, sf_dir, "orders").select("o_orderkey", *parts)


@query("fe_datetime_events", f"SELECT event_id, {_date_sql('ts')} FROM events")
def fe_datetime_events(spark, sf_dir):
    parts = [e.alias(n) for n, e in date_parts("ts").items()]
    return read(spark, sf_dir, "events").select("event_id", *parts)


@query(
    "fe_cyclical",
    """SELECT o_orderkey, ROUND(SIN(2 * PI() * MONTH(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_sin,
    ROUND(COS(2 * PI() * MONTH(o_orderdate) / 12), 6) + 0.0 AS o_orderdate_month_cos,
    ROUND(SIN(2 * PI() * DAY(o_orderdate) / 31), 6) + 0.0 AS o_orderdate_day_sin,
    ROUND(COS(2 * PI() * DAY(o_orderdate) / 31), 6) + 0.0 AS o_orderdate_day_cos FROM orders""",
)
def fe_cyclical(spark, sf_dir):
    # Adding zero turns a rounded -0.0 into 0.0.
    cycles = [(F.round(e, 6) + 0.0).alias(n) for n, e in date_cycles("o_orderdate").items()]
    return read(spark, sf_dir, "orders").select("o_orderkey", *cycles)


@query(
    "fe_log",
    """SELECT event_id, value, user_id, CASE WHEN g.lo > 0 AND g.s > 1 THEN ROUND(LN(1 + value), 6) END AS value_log
  FROM events, (SELECT MIN(value) AS lo, SKEWNESS(value) AS s FROM events) g""",
)
def fe_log(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "value", "user_id")
    made = numeric.fit_numeric_features(table, ["value", "user_id"]).transform(table)
    if "value_log" not in made.columns:
        # No logarithm is made of a column that is not positive or not skewed.
        made = made.withColumn("value_log", F.lit(None).cast("double"))
    return rounded(made.select("event_id", "value", "user_id", "value_log"))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_LIST = ", ".join(_LINE)


@query(
    "fe_square_sqrt",
    f"""SELECT {_LINE_LIST}, l_extendedprice * l_extendedprice AS l_extendedprice_squared,
    ROUND(SQRT(l_extendedprice), 6) AS l_extendedprice_sqrt,
    l_orderkey::DOUBLE * l_orderkey AS l_orderkey_squared, ROUND(SQRT(l_orderkey), 6) AS l_orderkey_sqrt,
    l_partkey::DOUBLE * l_partkey AS l_partkey_squared, ROUND(SQRT(l_partkey), 6) AS l_partkey_sqrt
  FROM lineitem""",
)
def fe_square_sqrt(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").select(*_LINE)
    made = numeric.fit_numeric_features(table, _LINE).transform(table)
    return made.select(
        *_LINE,
        *[
            F.round(c, 6).alias(c) if c.endswith("_sqrt") else F.col(c)
            for c in made.columns
            if c.endswith(("_squared", "_sqrt"))
        ],
    )


_TOP5 = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    "fe_products",
    f"SELECT {_LINE_LIST}, "
    + ", ".join(f"ROUND({a}::DOUBLE * {b}, 2) AS {a}_X_{b}" for a, b in combinations(_TOP5, 2))
    + " FROM lineitem",
)
def fe_products(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").select(*_LINE)
    made = numeric.fit_products(table, _LINE).transform(table)
    return rounded(made, 6, **{c: 2 for c in made.columns if "_X_" in c})


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "fe_ratio",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"{a} * {b} AS {a}_x_{b}, {a} / ({b} + 1e-8) AS {a}_div_{b}"
        for a, b in combinations(_MEASURES, 2)
    )
    + " FROM lineitem",
)
def fe_ratio(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    made = numeric.ratios(_MEASURES).transform(lines)
    new = [c for c in made.columns if c not in lines.columns]
    return made.select("l_orderkey", "l_linenumber", *new)


@query(
    "fe_poly",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f'ROUND({a} * {b}, 4) AS "poly_{a} {b}"' for a, b in combinations(_MEASURES, 2))
    + " FROM lineitem",
)
def fe_poly(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    made = numeric.fit_polynomial(lines, _MEASURES).transform(lines)
    new = [c for c in made.columns if c.startswith("poly_")]
    return made.select("l_orderkey", "l_linenumber", *[F.round(f"`{c}`", 4).alias(c) for c in new])


_GAP_NUMBERS = ["o_custkey", "o_totalprice", "o_orderkey"]


@query(
    "fe_row_stats",
    f"""SELECT o_orderkey, ROUND(LIST_AVG(v), 6) AS numeric_mean, ROUND(LIST_STDDEV_SAMP(v), 4) AS numeric_std,
    LIST_MAX(v) AS numeric_max, LIST_MIN(v) AS numeric_min, ROUND(LIST_MAX(v) - LIST_MIN(v), 6) AS numeric_range
  FROM (SELECT o_orderkey, LIST_FILTER([o_custkey::DOUBLE, o_totalprice::DOUBLE, o_orderkey::DOUBLE], lambda x: x IS NOT NULL) AS v
    FROM {GAPS_SQL})""",
)
def fe_row_stats(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir)
    made = numeric.row_features(_GAP_NUMBERS).transform(table)
    return rounded(
        made.select("o_orderkey", *[f"numeric_{s}" for s in ("mean", "std", "max", "min", "range")]),
        6,
        numeric_std=4,
    )


@query(
    "fe_clip_iqr",
    """SELECT event_id, ROUND(LEAST(GREATEST(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS value
  FROM events, (SELECT QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3 FROM events)""",
)
def fe_clip_iqr(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "value")
    return rounded(numeric.fit_clipping(table, ["value"]).transform(table))


@query(
    "fe_clip_z",
    """SELECT event_id, ROUND(LEAST(GREATEST(value, m - 2 * s), m + 2 * s), 6) AS value
  FROM events, (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS s FROM events)""",
)
def fe_clip_z(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "value")
    return rounded(numeric.fit_clipping(table, ["value"], "zscore", 2.0).transform(table))


# ---- scaling ---------------------------------------------------------------


@query(
    "fe_standard",
    f"""SELECT o_orderkey, ROUND((o_totalprice - m1) / s1, 6) + 0.0 AS o_totalprice, ROUND((o_custkey - m2) / s2, 6) + 0.0 AS o_custkey
  FROM orders, (SELECT AVG(o_totalprice) AS m1, STDDEV_POP(o_totalprice) AS s1, AVG(o_custkey) AS m2,
    STDDEV_POP(o_custkey) AS s2 FROM orders WHERE NOT {TEST_SQL})""",
)
def fe_standard(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    chosen = numeric.scalable_columns(_train(table), ["o_totalprice", "o_custkey"])
    scaled = numeric.fit_standard_scaling(_train(table), chosen).transform(table)
    return scaled.select("o_orderkey", *[(F.round(c, 6) + 0.0).alias(c) for c in chosen])


@query(
    "fe_scale_gate",
    union_sql(
        _LINE,
        lambda c: f"""SELECT * FROM (SELECT '{c}' AS "column", COUNT(DISTINCT {c}) > 2 AND MAX({c}) > 10 AS chosen FROM lineitem) WHERE chosen""",
    ),
)
def fe_scale_gate(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*_LINE)
    scaled = numeric.fit_standard_scaling(lines, numeric.scalable_columns(lines))
    rows = [(c, True) for c in scaled.params]
    return spark.createDataFrame(rows, "column string, chosen boolean")


@query(
    "fe_robust",
    f"""SELECT o_orderkey, ROUND((o_totalprice - q2) / (q3 - q1), 6) + 0.0 AS o_totalprice
  FROM orders, (SELECT QUANTILE_CONT(o_totalprice, 0.25) AS q1, QUANTILE_CONT(o_totalprice, 0.5) AS q2,
    QUANTILE_CONT(o_totalprice, 0.75) AS q3 FROM orders WHERE NOT {TEST_SQL})""",
)
def fe_robust(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scaled = numeric.fit_scaling(_train(table), method="robust", exclude=["o_orderkey"]).transform(table)
    return scaled.select("o_orderkey", (F.round("o_totalprice", 6) + 0.0).alias("o_totalprice"))


@query(
    "fe_preprocess",
    """WITH q AS (SELECT QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3 FROM events),
  c AS (SELECT event_id, LEAST(GREATEST(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS value FROM events, q),
  s AS (SELECT AVG(value) AS m, STDDEV_POP(value) AS s FROM c)
SELECT event_id, ROUND((value - m) / s, 6) + 0.0 AS value FROM c, s""",
)
def fe_preprocess(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "value")
    made = numeric.preprocess(table, {"exclude_from_scaling": ["event_id"]})
    return made.select(F.col("event_id").cast("bigint"), (F.round("value", 6) + 0.0).alias("value"))


# ---- encodings -------------------------------------------------------------


@query(
    "fe_label",
    """SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN (SELECT MIN(l_linestatus) FROM lineitem) THEN 0
    WHEN (SELECT MAX(l_linestatus) FROM lineitem) THEN 1 ELSE -1 END AS l_linestatus FROM lineitem""",
)
def fe_label(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return encode.fit_label_encoding(table, ["l_linestatus"]).transform(table)


@query(
    "fe_label_unseen",
    f"""SELECT o_orderkey, COALESCE(code, -1) AS o_orderpriority FROM {UNSEEN_SQL} o
  LEFT JOIN (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT o_orderpriority AS v FROM {UNSEEN_SQL} WHERE NOT {TEST_SQL})) m ON o.o_orderpriority = m.v""",
)
def fe_label_unseen(spark, sf_dir):
    table = orders_with_unseen(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    fitted = encode.fit_label_encoding(_train(table), ["o_orderpriority"], at_most=10)
    return fitted.transform(table)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "fe_onehot",
    "SELECT o_orderkey, "
    + ", ".join(
        f"""CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS "o_orderpriority_{v}" """ for v in _PRIORITIES
    )
    + f", CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END AS o_orderpriority_nan FROM {GAPS_SQL}",
)
def fe_onehot(spark, sf_dir):
    table = orders_with_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return encode.fit_one_hot(_train(table), ["o_orderpriority"]).transform(table)


@query(
    "fe_count",
    f"""SELECT o_orderkey, COALESCE(n, 0) AS o_orderpriority_count, COALESCE(k, 0) AS o_custkey_count FROM {UNSEEN_SQL} o
  LEFT JOIN (SELECT o_orderpriority AS v, COUNT(*) AS n FROM {UNSEEN_SQL} WHERE NOT {TEST_SQL} GROUP BY 1) a ON o.o_orderpriority = a.v
  LEFT JOIN (SELECT o_custkey AS c, COUNT(*) AS k FROM orders WHERE NOT {TEST_SQL} GROUP BY 1) b ON o.o_custkey = b.c""",
)
def fe_count(spark, sf_dir):
    table = orders_with_unseen(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_custkey")
    fitted = encode.fit_count_encoding(_train(table), ["o_orderpriority", "o_custkey"])
    return fitted.transform(table)


@query(
    "fe_freq",
    f"""SELECT o_orderkey, ROUND(COALESCE(n, 0)::DOUBLE / t, 6) AS o_orderpriority_freq FROM {UNSEEN_SQL} o
  LEFT JOIN (SELECT o_orderpriority AS v, COUNT(*) AS n FROM {UNSEEN_SQL} WHERE NOT {TEST_SQL} GROUP BY 1) a ON o.o_orderpriority = a.v,
  (SELECT COUNT(*) AS t FROM orders WHERE NOT {TEST_SQL})""",
)
def fe_freq(spark, sf_dir):
    table = orders_with_unseen(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    fitted = encode.fit_frequency_encoding(_train(table), ["o_orderpriority"])
    return rounded(fitted.transform(table).select("o_orderkey", "o_orderpriority_freq"))


@query(
    "fe_count_documents",
    """SELECT doc_id, n AS source_count, m AS lang_count FROM documents
  JOIN (SELECT source, COUNT(*) AS n FROM documents GROUP BY source) USING (source)
  JOIN (SELECT lang, COUNT(*) AS m FROM documents GROUP BY lang) USING (lang)""",
)
def fe_count_documents(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return encode.fit_count_encoding(table, ["source", "lang"]).transform(table)


@query(
    "fe_categorical_auto",
    """SELECT p_partkey, p_size, n AS p_brand_count, """
    + ", ".join(f"""CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END AS p_type_{v}""" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + """, 0 AS p_type_nan FROM part JOIN (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand) USING (p_brand)""",
)
def fe_categorical_auto(spark, sf_dir):
    table = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return encode.fit_categorical_encoding(table, ["p_brand", "p_type"]).transform(table)


@query(
    "fe_target_enc_oof",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_orderkey % 5 AS fold, l_extendedprice FROM lineitem),
  g AS (SELECT l_suppkey, fold, SUM(l_extendedprice) AS s, COUNT(*) AS n FROM t GROUP BY 1, 2),
  w AS (SELECT l_suppkey, SUM(s) AS s, SUM(n) AS n FROM g GROUP BY 1)
SELECT t.l_orderkey, t.l_linenumber, t.l_suppkey, t.l_extendedprice, ROUND(CASE WHEN w.n > g.n THEN (w.s - g.s) / (w.n - g.n)
    ELSE (SELECT AVG(l_extendedprice) FROM t) END, 4) AS l_suppkey_target_enc
  FROM t JOIN g ON t.l_suppkey = g.l_suppkey AND t.fold = g.fold JOIN w ON t.l_suppkey = w.l_suppkey""",
)
def fe_target_enc_oof(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", (F.col("l_orderkey") % 5).alias("fold")
    )
    fitted = encode.fit_target_encoding(table, ["l_suppkey"], "l_extendedprice")
    return rounded(fitted.transform_train(table).drop("fold"), 4)


@query(
    "fe_target_enc_test",
    f"""SELECT o_orderkey, ROUND(COALESCE(m, (SELECT AVG(o_totalprice) FROM orders WHERE NOT {TEST_SQL})), 4) AS o_orderpriority_target_enc
  FROM {UNSEEN_SQL} o LEFT JOIN (SELECT o_orderpriority AS v, AVG(o_totalprice) AS m FROM {UNSEEN_SQL}
    WHERE NOT {TEST_SQL} GROUP BY 1) a ON o.o_orderpriority = a.v""",
)
def fe_target_enc_test(spark, sf_dir):
    table = orders_with_unseen(spark, sf_dir).withColumn("fold", F.col("o_orderkey") % 5)
    fitted = encode.fit_target_encoding(_train(table), ["o_orderpriority"], "o_totalprice")
    made = fitted.transform(table)
    return rounded(made.select("o_orderkey", "o_orderpriority_target_enc"), 4)


# ---- groups and lags -------------------------------------------------------


@query(
    "fe_group_stats",
    f"""SELECT o_orderkey, ROUND(a, 6) AS o_totalprice_mean_by_o_custkey, ROUND(b, 4) AS o_totalprice_std_by_o_custkey,
    c AS o_totalprice_min_by_o_custkey, d AS o_totalprice_max_by_o_custkey, ROUND(e, 4) AS o_totalprice_median_by_o_custkey
  FROM orders LEFT JOIN (SELECT o_custkey AS k, AVG(o_totalprice) AS a, STDDEV_SAMP(o_totalprice) AS b, MIN(o_totalprice) AS c,
    MAX(o_totalprice) AS d, MEDIAN(o_totalprice) AS e FROM orders WHERE NOT {TEST_SQL} GROUP BY 1) g ON o_custkey = k""",
)
def fe_group_stats(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fitted = groups.fit_group_statistics(_train(table), ["o_custkey"], ["o_totalprice"])
    made = fitted.transform(table).drop("o_custkey", "o_totalprice")
    return rounded(made, 4, o_totalprice_mean_by_o_custkey=6)


@query(
    "fe_group_window",
    """SELECT event_id, ROUND(AVG(value) OVER w, 4) AS value_mean_by_user_id, ROUND(STDDEV_SAMP(value) OVER w, 4) AS value_std_by_user_id,
    MAX(value) OVER w AS value_max_by_user_id, MIN(value) OVER w AS value_min_by_user_id
  FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def fe_group_window(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    made = groups.group_transform(table, "user_id", ["value"])
    return rounded(made.drop("user_id", "value"), 4)


@query(
    "fe_lag",
    """SELECT event_id, user_id, value, LAG(value, 1) OVER w AS value_lag_1_by_user_id, LAG(value, 2) OVER w AS value_lag_2_by_user_id,
    LAG(value, 3) OVER w AS value_lag_3_by_user_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def fe_lag(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return groups.lag_features(table, "user_id", ["value"], ["ts", "event_id"]).drop("ts")


@query(
    "fe_lag_types",
    """SELECT event_id, event_type, value, LAG(value, 1) OVER w AS value_lag_1_by_event_type
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def fe_lag_types(spark, sf_dir):
    table = read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    # Every type holds a fifth of the rows: small tasks force the split of hot groups.
    made = groups.lag_features(table, "event_type", ["value"], ["ts", "event_id"], [1], in_one_task=500)
    return made.drop("ts")


# ---- selection -------------------------------------------------------------


def _mi_sql(table: str, features: list[str], target: str) -> str:
    def bins(c: str) -> str:
        return "(" + " + ".join(f"COALESCE(({c} > q[{i}])::INT, 0)" for i in range(1, 10)) + ")"

    def part(c: str) -> str:
        probs = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
        return f"""SELECT '{c}' AS feature, ROUND(SUM(n / t * LN(n * t / (b * c))), 6) AS mi FROM (
    SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY bin) AS b, SUM(n) OVER (PARTITION BY cls) AS c FROM (
      SELECT {bins(c)} AS bin, {target} AS cls, COUNT(*)::DOUBLE AS n
        FROM {table}, (SELECT LIST_SORT(LIST_DISTINCT(QUANTILE_CONT({c}::DOUBLE, {probs}))) AS q FROM {table}) GROUP BY 1, 2))"""

    return union_sql(features, part)


@query("fe_mi_binned", _mi_sql(LABELLED_SQL, ["n_chars", "doc_id"], "quality"))
def fe_mi_binned(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    return rounded(select.mutual_information(docs, ["n_chars", "doc_id"], "quality"))


@query("fe_mi_lines", _mi_sql("lineitem", ["l_extendedprice", "l_partkey", "l_suppkey"], "l_returnflag"))
def fe_mi_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return rounded(select.mutual_information(lines, ["l_extendedprice", "l_partkey", "l_suppkey"], "l_returnflag"))


def _value_bins_sql(c: str) -> str:
    return "(" + " + ".join(f"COALESCE(({c} > e.t[{i}])::INT, 0)" for i in range(1, 10)) + ")"


_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"


@query(
    "fe_mi_regression",
    _mi_sql(
        f"""(SELECT l_quantity, l_extendedprice, {_value_bins_sql("l_extendedprice")} AS price_bin FROM lineitem,
    (SELECT LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(l_extendedprice, {_PROBS}))) AS t FROM lineitem) e)""",
        ["l_quantity"],
        "price_bin",
    ),
)
def fe_mi_regression(spark, sf_dir):
    """A numeric target is binned like the features."""
    lines = read(spark, sf_dir, "lineitem")
    return rounded(select.mutual_information(lines, ["l_quantity"], "l_extendedprice"))


@query(
    "fe_group_medians_ranked",
    """SELECT l_returnflag, ROUND(AVG(l_extendedprice), 4) AS l_extendedprice_mean_by_l_returnflag,
    ROUND(MEDIAN(l_extendedprice), 4) AS l_extendedprice_median_by_l_returnflag, ROUND(AVG(l_quantity), 4) AS l_quantity_mean_by_l_returnflag,
    MEDIAN(l_quantity) AS l_quantity_median_by_l_returnflag FROM lineitem GROUP BY l_returnflag""",
)
def fe_group_medians_ranked(spark, sf_dir):
    """Groups too large to keep together: their values are ranked range by range."""
    lines = read(spark, sf_dir, "lineitem")
    columns = ["l_extendedprice", "l_quantity"]
    table = groups.group_table(lines, "l_returnflag", columns, ("mean", "median"), in_one_group=100)
    return rounded(table, 4)


@query(
    "fe_count_salted",
    """SELECT l_orderkey, l_linenumber, l_partkey, n AS l_returnflag_count, m AS l_suppkey_count FROM lineitem
  JOIN (SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1) USING (l_returnflag)
  JOIN (SELECT l_suppkey, COUNT(*) AS m FROM lineitem GROUP BY 1) USING (l_suppkey)""",
)
def fe_count_salted(spark, sf_dir):
    """The plan for count tables too large to broadcast; the flag's values are all hot."""
    lines = read(spark, sf_dir, "lineitem")
    table = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey")
    fitted = encode.fit_count_encoding(table, ["l_returnflag", "l_suppkey"], max_rows=0)
    return fitted.transform(table)


@query("fe_select")
def fe_select(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).drop("toxic")
    chosen = select.select_features(docs.drop("doc_id"), "quality", max_features=3)
    return docs.select("doc_id", "quality", *chosen)
