"""Profiling and data-quality queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..operators import profile, quality, schema
from .base import (
    GAPS_SQL,
    LABELLED_SQL,
    labelled_documents,
    orders_with_gaps,
    query,
    read,
    rounded,
    union_sql,
)

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql(c: str) -> str:
    return f"""ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
    CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
    ROUND(QUANTILE_CONT({c}::DOUBLE, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({c}::DOUBLE, 0.5), 6) AS q50,
    ROUND(QUANTILE_CONT({c}::DOUBLE, 0.75), 6) AS q75"""


@query(
    "eda_distributions",
    union_sql(
        LINE_NUMBERS,
        lambda c: f"""SELECT '{c}' AS "column", mean, std, min, max, q25, q50, q75,
    ROUND((SELECT COUNT(*) FROM lineitem
      WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) * 100.0::DOUBLE / n, 6) AS outliers_pct
  FROM (SELECT {_summary_sql(c)}, COUNT(*) AS n FROM lineitem)""",
    ),
)
def eda_distributions(spark, sf_dir):
    return rounded(profile.distributions(read(spark, sf_dir, "lineitem")))


@query(
    "eda_outlier_share",
    union_sql(
        ["value", "n_chars"],
        lambda c: f"""SELECT '{c}' AS "column", ROUND((SELECT COUNT(*) FROM {t}
      WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) * 100.0::DOUBLE / n, 6) AS outliers_pct
  FROM (SELECT QUANTILE_CONT({c}::DOUBLE, 0.25) AS q25, QUANTILE_CONT({c}::DOUBLE, 0.75) AS q75,
    COUNT(*) AS n FROM {t})"""
        if (t := {"value": "events", "n_chars": "documents"}[c])
        else "",
    ),
)
def eda_outlier_share(spark, sf_dir):
    events = profile.distributions(read(spark, sf_dir, "events"), ["value"])
    docs = profile.distributions(read(spark, sf_dir, "documents"), ["n_chars"])
    return rounded(events.unionByName(docs).select("column", "outliers_pct"))


@query(
    "eda_describe",
    union_sql(
        ["o_orderkey", "o_custkey", "o_totalprice"],
        lambda c: f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", {_summary_sql(c)} FROM {GAPS_SQL}""",
    ),
)
def eda_describe(spark, sf_dir):
    return rounded(profile.describe(orders_with_gaps(spark, sf_dir)))


@query(
    "eda_basic_info",
    """SELECT 'orders' AS "table", 'rows' AS metric, COUNT(*) AS value FROM orders
UNION ALL SELECT 'orders', 'columns', 6::BIGINT
UNION ALL SELECT 'orders', 'type bigint', 2::BIGINT
UNION ALL SELECT 'orders', 'type string', 2::BIGINT
UNION ALL SELECT 'orders', 'type double', 1::BIGINT
UNION ALL SELECT 'orders', 'type timestamp_ntz', 1::BIGINT""",
)
def eda_basic_info(spark, sf_dir):
    return profile.basic_info(read(spark, sf_dir, "orders"), "orders")


_GAP_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "eda_missing",
    "SELECT * FROM ("
    + union_sql(
        _GAP_COLUMNS,
        lambda c: f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing,
    ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2) AS pct,
    ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2) > 50 AS high_missing FROM {GAPS_SQL}""",
    )
    + ") WHERE missing > 0",
)
def eda_missing(spark, sf_dir):
    return profile.missing_values(orders_with_gaps(spark, sf_dir))


@query(
    "eda_top_missing",
    "SELECT * FROM ("
    + union_sql(
        _GAP_COLUMNS,
        lambda c: f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing FROM {GAPS_SQL}""",
    )
    + ') WHERE missing > 0 ORDER BY missing DESC, "column" LIMIT 10',
)
def eda_top_missing(spark, sf_dir):
    return profile.top_missing(orders_with_gaps(spark, sf_dir)).select("column", "missing")


@query(
    "eda_moments",
    union_sql(
        ["value", "n_chars", "l_extendedprice"],
        lambda c: f"""SELECT '{c}' AS "column", ROUND(SKEWNESS({c}), 6) AS skewness,
    ROUND(KURTOSIS({c}), 6) AS kurtosis
  FROM {dict(value="events", n_chars="documents", l_extendedprice="lineitem")[c]}""",
    ),
)
def eda_moments(spark, sf_dir):
    return rounded(
        profile.moments(read(spark, sf_dir, "events"), ["value"])
        .unionByName(profile.moments(read(spark, sf_dir, "documents"), ["n_chars"]))
        .unionByName(profile.moments(read(spark, sf_dir, "lineitem"), ["l_extendedprice"]))
    )


@query("eda_target_dist", f"SELECT quality, COUNT(*) AS n FROM {LABELLED_SQL} GROUP BY quality")
def eda_target_dist(spark, sf_dir):
    return profile.target_distribution(labelled_documents(spark, sf_dir), "quality")


@query(
    "eda_imbalance",
    f"""SELECT COUNT(*) AS classes, ROUND(MIN(n)::DOUBLE / MAX(n), 6) AS ratio, MIN(n)::DOUBLE / MAX(n) < 0.2 AS severe
  FROM (SELECT toxic, COUNT(*) AS n FROM {LABELLED_SQL} GROUP BY toxic) HAVING COUNT(*) = 2""",
)
def eda_imbalance(spark, sf_dir):
    return rounded(profile.class_imbalance(labelled_documents(spark, sf_dir), "toxic"))


# Lineitem with three derived amounts, so that some pairs correlate strongly.
_AMOUNTS_SQL = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax,
    l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
  FROM lineitem)"""
_AMOUNTS = [*MEASURES, "net", "charge"]


def _amounts(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select(
        *MEASURES, net.alias("net"), (net * (1 + F.col("l_tax"))).alias("charge")
    )


@query(
    "eda_corr_long",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, ROUND(CORR({a}, {b}), 6) AS corr FROM {_AMOUNTS_SQL}"
        for a, b in combinations(_AMOUNTS, 2)
    ),
)
def eda_corr_long(spark, sf_dir):
    return rounded(profile.correlations(_amounts(spark, sf_dir)))


@query(
    "eda_high_corr",
    "SELECT feature1, feature2, ROUND(corr, 3) AS corr FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, CORR({a}, {b}) AS corr FROM {_AMOUNTS_SQL}"
        for a, b in combinations(_AMOUNTS, 2)
    )
    + ") WHERE ABS(corr) > 0.8",
)
def eda_high_corr(spark, sf_dir):
    return profile.high_correlations(_amounts(spark, sf_dir))


@query(
    "eda_top_corr",
    "SELECT feature1, feature2, ROUND(corr, 3) AS corr FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, CORR({a}, {b}) AS corr FROM {_AMOUNTS_SQL}"
        for a, b in combinations(_AMOUNTS, 2)
    )
    + ") WHERE ABS(corr) > 0.8 ORDER BY ABS(ROUND(corr, 3)) DESC, feature1, feature2 LIMIT 2",
)
def eda_top_corr(spark, sf_dir):
    return profile.top_correlations(_amounts(spark, sf_dir), k=2)


# Twelve measures of order lines, each with gaps of its own. The first has values far from
# all others just where the second one is missing.
_HOLED = {
    "m0": ("l_linenumber % 4 = 0", "CASE WHEN l_linenumber % 3 = 0 THEN 1000000000000.0::DOUBLE ELSE l_quantity END"),
    "m1": ("l_linenumber % 3 = 0", "l_quantity * 2 + l_linenumber"),
    "m2": ("l_orderkey % 5 = 1", "l_extendedprice"),
    "m3": ("l_orderkey % 7 = 2", "l_discount"),
    "m4": ("l_orderkey % 11 < 4", "l_tax"),
    "m5": ("l_partkey % 3 = 0", "l_partkey::DOUBLE"),
    "m6": ("l_suppkey % 2 = 0", "l_suppkey::DOUBLE"),
    "m7": ("l_partkey % 13 < 9", "l_extendedprice * (1 - l_discount)"),
    "m8": ("l_orderkey % 3 = 2", "l_quantity - l_tax * 100"),
    "m9": ("l_suppkey % 5 > 2", "l_linenumber::DOUBLE"),
    "m10": ("l_linenumber % 3 <> 0", "l_orderkey::DOUBLE"),
    "m11": ("l_orderkey % 2 = 0", "7.0::DOUBLE"),
}
_HOLED_SQL = "(SELECT " + ", ".join(f"CASE WHEN {gap} THEN NULL ELSE {v} END AS {c}" for c, (gap, v) in _HOLED.items()) + " FROM lineitem)"


def _pair_sql(a: str, b: str) -> str:
    varies = f"REGR_SXX({a}, {b}) > 0 AND REGR_SYY({a}, {b}) > 0"
    return f"SELECT '{a}' AS feature1, '{b}' AS feature2, CASE WHEN {varies} THEN ROUND(CORR({a}, {b}), 6) + 0.0 END AS corr FROM holed"


@query(
    "eda_corr_holed",
    f"WITH holed AS {_HOLED_SQL} " + "\nUNION ALL\n".join(_pair_sql(a, b) for a, b in combinations(_HOLED, 2)),
)
def eda_corr_holed(spark, sf_dir):
    """Twelve columns with gaps: each pair by the rows that hold both."""
    lines = read(spark, sf_dir, "lineitem")
    holed = [
        F.expr(f"CASE WHEN {gap} THEN NULL ELSE {v.replace('::DOUBLE', '')} END").cast("double").alias(c) for c, (gap, v) in _HOLED.items()
    ]
    found = rounded(profile.correlations(lines.select(*holed)))
    return found.withColumn("corr", F.col("corr") + 0.0)


@query(
    "eda_corr_gaps",
    f"""SELECT 'o_orderkey' AS feature1, 'o_custkey' AS feature2, ROUND(CORR(o_orderkey, o_custkey), 6) AS corr FROM {GAPS_SQL}
UNION ALL SELECT 'o_orderkey', 'o_totalprice', ROUND(CORR(o_orderkey, o_totalprice), 6) FROM {GAPS_SQL}
UNION ALL SELECT 'o_custkey', 'o_totalprice', ROUND(CORR(o_custkey, o_totalprice), 6) FROM {GAPS_SQL}""",
)
def eda_corr_gaps(spark, sf_dir):
    """Pairwise complete: every pair has its own rows."""
    return rounded(profile.correlations(orders_with_gaps(spark, sf_dir)))


@query(
    "eda_describe_narrowed",
    union_sql(
        LINE_NUMBERS,
        lambda c: f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", {_summary_sql(c)} FROM lineitem""",
    ),
)
def eda_describe_narrowed(spark, sf_dir):
    """The plan for tables too large for one task."""
    return rounded(profile.describe(read(spark, sf_dir, "lineitem"), in_one_task=1000))


@query(
    "eda_target_corr",
    'WITH c AS ('
    + union_sql(
        [c for c in _AMOUNTS if c != "l_extendedprice"],
        lambda c: f"""SELECT '{c}' AS "column", CORR({c}, l_extendedprice) AS corr FROM {_AMOUNTS_SQL}""",
    )
    + """), r AS (SELECT "column", corr, ROW_NUMBER() OVER (ORDER BY corr DESC, "column") AS from_top,
    ROW_NUMBER() OVER (ORDER BY corr, "column" DESC) AS from_bottom FROM c)
SELECT "column", ROUND(corr, 6) AS corr, CAST(from_top AS INTEGER) AS from_top,
    CAST(from_bottom AS INTEGER) AS from_bottom FROM r WHERE from_top <= 2 OR from_bottom <= 2""",
)
def eda_target_corr(spark, sf_dir):
    return rounded(profile.target_correlations(_amounts(spark, sf_dir), "l_extendedprice", k=2))


_PART_TEXTS = ["p_name", "p_brand", "p_type"]


@query(
    "eda_categorical",
    union_sql(
        _PART_TEXTS,
        lambda c: f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS unique_values,
    COUNT(*) - COUNT({c}) AS missing_count, COUNT(DISTINCT {c}) > 50 AS high_cardinality FROM part""",
    ),
)
def eda_categorical(spark, sf_dir):
    return profile.categorical_profile(read(spark, sf_dir, "part"))


@query(
    "eda_top_values",
    union_sql(
        _PART_TEXTS,
        lambda c: f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, COUNT(*) AS n,
    CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS rank FROM part GROUP BY {c}) WHERE rank <= 10""",
    ),
)
def eda_top_values(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "part"))


@query(
    "eda_top_texts",
    """SELECT * FROM (SELECT 'text' AS "column", text AS value, COUNT(*) AS n,
    CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, text) AS INTEGER) AS rank FROM documents GROUP BY text) WHERE rank <= 10""",
)
def eda_top_texts(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "documents"), ["text"])


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "eda_distinct_counts",
    union_sql(
        [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"],
        lambda c: f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS n_unique FROM lineitem""",
    ),
)
def eda_distinct_counts(spark, sf_dir):
    return profile.distinct_counts(read(spark, sf_dir, "lineitem"))


def _kind_sql(table: str, kinds: dict[str, str]) -> str:
    def part(c: str) -> str:
        named = "TRUE" if "id" in c.split("_") else "FALSE"
        other = {
            "text": f"CASE WHEN COUNT(DISTINCT {c})::DOUBLE / COUNT(*) > 0.5 THEN 'text' ELSE 'categorical' END"
        }.get(kinds[c], f"'{kinds[c]}'")
        return f"""SELECT '{c}' AS "column",
    CASE WHEN {named} OR COUNT(DISTINCT {c}) = COUNT(*) THEN 'id' ELSE {other} END AS semantic_type FROM {table}"""

    return union_sql(list(kinds), part)


_CUSTOMER_KINDS = dict(
    c_custkey="numeric", c_name="text", c_nationkey="numeric", c_acctbal="numeric", c_mktsegment="text"
)
_DOCUMENT_KINDS = dict(doc_id="numeric", text="text", lang="text", source="text", n_chars="numeric")
_EVENT_KINDS = dict(
    event_id="numeric", ts="datetime", user_id="numeric", event_type="text", value="numeric", props="text"
)


@query("eda_types_customer", _kind_sql("customer", _CUSTOMER_KINDS))
def eda_types_customer(spark, sf_dir):
    return schema.semantic_types(read(spark, sf_dir, "customer"))


@query("eda_types_documents", _kind_sql("documents", _DOCUMENT_KINDS))
def eda_types_documents(spark, sf_dir):
    return schema.semantic_types(read(spark, sf_dir, "documents"))


@query("eda_types_events", _kind_sql("events", _EVENT_KINDS))
def eda_types_events(spark, sf_dir):
    return schema.semantic_types(read(spark, sf_dir, "events"))


_TEXT_DATES_SQL = """(SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS date_text, o_orderpriority AS date_word,
    o_orderdate, o_totalprice, o_orderstatus FROM orders)"""


@query(
    "eda_simple_types",
    f"""SELECT 'o_orderkey' AS "column", 'numeric' AS simple_type
UNION ALL SELECT 'date_text', CASE WHEN BOOL_AND(TRY_CAST(date_text AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'categorical' END FROM {_TEXT_DATES_SQL}
UNION ALL SELECT 'date_word', CASE WHEN BOOL_AND(TRY_CAST(date_word AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'categorical' END FROM {_TEXT_DATES_SQL}
UNION ALL SELECT 'o_orderdate', 'datetime'
UNION ALL SELECT 'o_totalprice', 'numeric'
UNION ALL SELECT 'o_orderstatus', 'categorical'""",
)
def eda_simple_types(spark, sf_dir):
    table = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("string").alias("date_text"),
        F.col("o_orderpriority").alias("date_word"),
        "o_orderdate",
        "o_totalprice",
        "o_orderstatus",
    )
    return schema.simple_types(table)


@query(
    "eda_numeric_columns",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def eda_numeric_columns(spark, sf_dir):
    table = read(spark, sf_dir, "orders")
    return table.select(*numeric_columns(table))


@query("eda_target_column", "SELECT 'quality' AS target, quality AS value, COUNT(*) AS n FROM labels GROUP BY quality")
def eda_target_column(spark, sf_dir):
    train = read(spark, sf_dir, "labels")
    target = schema.target_column(train, train.select("doc_id", "toxic"))
    counted = profile.target_distribution(train, target)
    return counted.select(F.lit(target).alias("target"), F.col(target).alias("value"), "n")


@query(
    "eda_insights",
    """SELECT 'skewed' AS rule, COUNT(*) AS value, COUNT(*) || ' numeric columns lean to one side' AS message
  FROM (SELECT SKEWNESS(n_chars) AS s FROM documents UNION ALL SELECT SKEWNESS(doc_id) FROM documents)
  WHERE ABS(s) > 1 HAVING COUNT(*) > 0""",
)
def eda_insights(spark, sf_dir):
    return profile.insights(read(spark, sf_dir, "documents"))


@query(
    "eda_insights_orders",
    "SELECT 'missing' AS rule, COUNT(*) AS value, COUNT(*) || ' of the columns hold gaps' AS message FROM ("
    + union_sql(_GAP_COLUMNS, lambda c: f"SELECT COUNT(*) - COUNT({c}) AS m FROM {GAPS_SQL}")
    + ") WHERE m > 0 HAVING COUNT(*) > 0",
)
def eda_insights_orders(spark, sf_dir):
    return profile.insights(orders_with_gaps(spark, sf_dir))


def _histogram_sql(table: str, columns: list[str], bins: int = 30) -> str:
    return union_sql(
        columns,
        lambda c: f"""SELECT '{c}' AS "column",
    CAST(LEAST(FLOOR(({c}::DOUBLE - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, COUNT(*) AS n
  FROM {table}, (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM {table}) GROUP BY ALL""",
    )


@query("eda_histogram", _histogram_sql("events", ["value"]))
def eda_histogram(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "events"), ["value"])


@query("eda_histogram_lines", _histogram_sql("lineitem", MEASURES))
def eda_histogram_lines(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "lineitem"), MEASURES)


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _quality_sql(table: str, columns: list[str], texts: list[str]) -> str:
    return union_sql(
        columns,
        lambda c: f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing,
    ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 6) AS missing_pct,
    (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) > 90 AS warn_missing, COUNT({c}) = 0 AS all_null,
    COUNT(DISTINCT {c}) = 1 AS constant,
    {f"COUNT(DISTINCT {c}) > 0.8 * COUNT(*)" if c in texts else "FALSE"} AS high_cardinality FROM {table}""",
    )


@query("eda_quality", _quality_sql("part", _PART, _PART_TEXTS))
def eda_quality(spark, sf_dir):
    return rounded(quality.quality_report(read(spark, sf_dir, "part")))


@query(
    "eda_quality_gaps",
    _quality_sql(GAPS_SQL, _GAP_COLUMNS, ["o_orderstatus", "o_orderpriority"]),
)
def eda_quality_gaps(spark, sf_dir):
    return rounded(quality.quality_report(orders_with_gaps(spark, sf_dir)))


@query(
    "eda_duplicates",
    "SELECT (SELECT COUNT(*) FROM lineitem) AS rows,"
    " (SELECT COUNT(*) FROM lineitem) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows",
)
def eda_duplicates(spark, sf_dir):
    return quality.duplicate_rows(read(spark, sf_dir, "lineitem"))


@query(
    "eda_duplicate_texts",
    "SELECT (SELECT COUNT(*) FROM documents) AS rows, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows"
    " FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text)",
)
def eda_duplicate_texts(spark, sf_dir):
    return quality.duplicate_rows(read(spark, sf_dir, "documents").select("text"))


@query(
    "eda_schema_check",
    """SELECT * FROM (VALUES ('o_orderpriority', 'missing'), ('net', 'extra')) t("column", issue)
  WHERE (SELECT COUNT(*) FROM orders) > 0""",
)
def eda_schema_check(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    other = orders.withColumn("net", F.col("o_totalprice") * 0.9).drop("o_orderpriority")
    quality.check_frame(orders, "orders")
    quality.check_target(orders, "o_totalprice")
    quality.check_same_keys(orders, other, "o_orderkey")
    return quality.check_schema(orders, other)


@query(
    "eda_task_simple",
    """SELECT COUNT(DISTINCT quality) AS n_unique,
    CASE WHEN COUNT(DISTINCT quality) < 10 THEN 'classification' ELSE 'regression' END AS task_type, 'quality' AS target FROM labels
UNION ALL SELECT COUNT(DISTINCT value), CASE WHEN COUNT(DISTINCT value) < 10 THEN 'classification' ELSE 'regression' END, 'value' FROM events
UNION ALL SELECT COUNT(DISTINCT o_orderstatus), 'classification', 'o_orderstatus' FROM orders""",
)
def eda_task_simple(spark, sf_dir):
    parts = [("labels", "quality"), ("events", "value"), ("orders", "o_orderstatus")]
    return _stacked(
        [schema.simple_task_type(read(spark, sf_dir, t), c).withColumn("target", F.lit(c)) for t, c in parts]
    )


def _stacked(frames):
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


def _task_sql(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS target, n_unique, CASE
    WHEN n_unique = 2 THEN 'classification'
    WHEN integral AND n_unique <= 20 THEN 'classification'
    WHEN integral THEN 'regression'
    WHEN low >= 0 AND high <= 1 AND n_unique > 10 THEN 'regression'
    WHEN n_unique <= 30 AND largest >= n * 0.05 THEN 'classification'
    ELSE 'regression' END AS task_type
  FROM (SELECT COUNT(DISTINCT {c}) AS n_unique, BOOL_AND({c} = FLOOR({c})) AS integral, MIN({c}) AS low,
    MAX({c}) AS high, COUNT(*) AS n FROM {table}),
    (SELECT MAX(k) AS largest FROM (SELECT COUNT(*) AS k FROM {table} GROUP BY {c}))"""


_TASKS = [
    ("labels", "quality"), ("part", "p_size"), ("lineitem", "l_discount"), ("lineitem", "l_linenumber"),
    ("events", "value"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"),
]


@query("eda_task_improved", "\nUNION ALL\n".join(_task_sql(t, c) for t, c in _TASKS))
def eda_task_improved(spark, sf_dir):
    return _stacked(
        [schema.task_type(read(spark, sf_dir, t), c).withColumn("target", F.lit(c)) for t, c in _TASKS]
    )


@query(
    "eda_task_hints",
    """SELECT 'by metric' AS hint, COUNT(DISTINCT l_quantity) AS n_unique, 'classification' AS task_type FROM lineitem
UNION ALL SELECT 'by error metric', COUNT(DISTINCT l_quantity), 'regression' FROM lineitem
UNION ALL SELECT 'by class name', COUNT(DISTINCT l_quantity), 'classification' FROM lineitem
UNION ALL SELECT 'by value name', COUNT(DISTINCT l_quantity),
    CASE WHEN COUNT(DISTINCT l_quantity) <= 10 AND BOOL_AND(l_quantity = FLOOR(l_quantity)) THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'by rating name', COUNT(DISTINCT l_linenumber),
    CASE WHEN COUNT(DISTINCT l_linenumber) <= 10 AND BOOL_AND(l_linenumber = FLOOR(l_linenumber)) THEN 'classification' ELSE 'regression' END FROM lineitem""",
)
def eda_task_hints(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    cases = [
        ("by metric", "l_quantity", "AUC", None),
        ("by error metric", "l_quantity", "root mean squared error", None),
        ("by class name", "l_quantity", None, "customer_group"),
        ("by value name", "l_quantity", None, "quantity"),
        ("by rating name", "l_linenumber", None, "rating"),
    ]
    return _stacked(
        [schema.task_type(lines, c, metric, name).withColumn("hint", F.lit(h)) for h, c, metric, name in cases]
    )


@query(
    "eda_task_details",
    f"""SELECT COUNT(*) AS n_unique, FALSE AS has_missing, COUNT(*) = 2 AS is_binary, COUNT(*) > 2 AS is_multiclass,
    ROUND(MAX(n)::DOUBLE / MIN(n), 6) AS imbalance_ratio
  FROM (SELECT quality, COUNT(*) AS n FROM {LABELLED_SQL} GROUP BY quality)""",
)
def eda_task_details(spark, sf_dir):
    return rounded(schema.class_details(labelled_documents(spark, sf_dir), "quality"))


@query(
    "eda_value_details",
    """SELECT COUNT(*) > COUNT(value) AS has_missing, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std,
    MIN(value) AS min, MAX(value) AS max, ROUND(SKEWNESS(value), 6) AS skewness FROM events""",
)
def eda_value_details(spark, sf_dir):
    return rounded(schema.value_details(read(spark, sf_dir, "events"), "value"))


@query(
    "eda_class_distribution",
    "SELECT o_orderpriority AS class, COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
)
def eda_class_distribution(spark, sf_dir):
    return schema.class_distribution(read(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "eda_variance_top",
    'SELECT "column", CAST(position AS INTEGER) AS position, ROUND(variance, 2) AS variance FROM ('
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {i} AS position, VAR_SAMP({c}::DOUBLE) AS variance FROM lineitem"""
        for i, c in enumerate(LINE_NUMBERS)
    )
    + ") ORDER BY 3 DESC, 2 LIMIT 3",
)
def eda_variance_top(spark, sf_dir):
    found = profile.top_variance(read(spark, sf_dir, "lineitem"), k=3)
    return rounded(found.withColumn("position", F.col("position").cast("int")), 2)
