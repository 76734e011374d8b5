"""Row numbers and running totals without one task per group.

A window orders a whole partition in one task. When a partition is larger than
``IN_ONE_TASK`` rows, the order is cut into ranges first: each range is ordered by
itself and starts at the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import quoted
from .sizing import broadcast_if_small

IN_ONE_TASK = 5_000_000
# Of a range that is cut again; with the values between and the missing ones, two hex digits tell them apart.
EDGES = 100
ACCURACY = 1000
# With their number, six bytes of a text stay exact as a double, which quantiles are made of.
TEXT_BYTES = 6
_SHARDS = 64
_PROBES = 1000


def range_edges(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Cut points that split ``column`` into about ``ranges`` equal parts.

    Sketches are merged per shard first, so that no task merges one sketch per
    input split. The cuts only balance the work; results do not depend on them.
    """
    # More ranges than probes would leave the cuts between two probes together.
    n_probes = max(_PROBES, 2 * ranges)
    probes = [i / n_probes for i in range(1, n_probes)]
    sketches = (
        df.select(F.col(column).cast("double").alias("v"))
        .groupBy((F.spark_partition_id() % _SHARDS).alias("shard"))
        .agg(F.percentile_approx("v", probes, n_probes).alias("q"), F.count("v").alias("n"))
        .select(F.explode("q").alias("v"), "n")
    )
    wanted = [i / ranges for i in range(1, ranges)]
    cuts = sketches.agg(F.percentile("v", wanted, F.col("n")).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def with_range(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add the index of the range that ``column`` falls into."""
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    double = f"__{name}_of"
    cutter = Bucketizer(splits=splits, inputCol=double, outputCol=name, handleInvalid="keep")
    # As in an ascending order, NULL comes first and NaN last.
    number = F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))
    return cutter.transform(df.withColumn(double, number)).drop(double)


def _kind(df: DataFrame, column: str) -> str:
    name = df.schema[column].dataType.typeName()
    if name in ("string", "binary"):
        return "text"
    if name in ("float", "double", "decimal"):
        return "double"
    if name in ("byte", "short", "integer", "long", "boolean", "date", "timestamp", "timestamp_ntz"):
        return "long"
    raise ValueError(f"{column} of type {name} cannot be cut into ranges")


def _parts(df: DataFrame, column: str, chunk: Column) -> tuple[Column, Column]:
    """A column's value as a long or a double (the other is NULL); texts by six bytes at a time.

    Both never fall as the column rises.
    """
    name, c = df.schema[column].dataType.typeName(), quoted(column)
    no_long, no_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    if _kind(df, column) == "double":
        return no_long, c.cast("double")
    if name in ("string", "binary"):
        some = F.substring(c.cast("binary"), chunk * TEXT_BYTES + 1, F.lit(TEXT_BYTES))
        number = F.conv(F.rpad(F.hex(some), 2 * TEXT_BYTES, "0"), 16, 10).cast("long")
        # A text that ends comes before one that goes on with zero bytes.
        return number * (TEXT_BYTES + 1) + F.octet_length(some), no_double
    if name == "date":
        return F.unix_date(c).cast("long"), no_double
    if name == "timestamp":
        return F.unix_micros(c), no_double
    if name == "timestamp_ntz":
        # By its parts: a conversion through the session's zone may step back.
        minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"), no_double
    return c.cast("long"), no_double


def _by_level(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """The value that a row's range is cut by, long or double, whether it is missing, and a text's bytes."""
    none = F.lit(None)
    long, double = none.cast("long"), none.cast("double")
    missing, size = F.lit(False), F.lit(0)
    for k, c in enumerate(order):
        here = F.col("__k") == k
        a, b = _parts(df, c, F.col("__c"))
        long, double = F.when(here, a).otherwise(long), F.when(here, b).otherwise(double)
        missing = F.when(here, quoted(c).isNull()).otherwise(missing)
        if _kind(df, c) == "text":
            size = F.when(here, F.coalesce(F.octet_length(quoted(c)), F.lit(0))).otherwise(size)
    return long, double, missing, size


def split_ranges(df: DataFrame, order: Sequence[str], in_one_task: int, name: str = "__range") -> DataFrame:
    """Add a text ``name`` that rises with ``order`` and holds at most ``in_one_task`` rows, ties on all columns apart.

    A range that counts more is cut again, by up to ``EDGES`` of its own quantiles: a value that is
    an edge becomes a range of its own between its neighbours. Rows tied on the column (missing
    values are) are cut by the next one, texts six bytes at a time. Cuts are small tables joined
    to the rows, so neither the number of ranges nor a tied column sets an end. Ascending order,
    NULL first and NaN last. Each level is written; ``df`` should be cheap to read again.
    """
    order = list(order)
    rows = df.withColumn(name, F.lit("")).withColumns({"__k": F.lit(0), "__c": F.lit(0), "__tied": F.lit(False)})
    probs = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
    ended = len(order)
    # Decimals of more digits than a double has: equal doubles do not mean a tie.
    inexact = [k for k, c in enumerate(order) if getattr(df.schema[c].dataType, "precision", 0) > 15]
    while True:
        long, double, missing, size = _by_level(df, order)
        seen = rows.withColumns({"__l": long, "__d": double, "__none": missing, "__size": size})
        state = F.struct("__k", "__c", "__tied")
        full = seen.where(F.col("__k") < ended).groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.first(state).alias("s"), F.max("__size").alias("size"), F.first("__none").alias("none")
        )
        more = F.col("size") > (F.col("s.__c") + 1) * TEXT_BYTES
        texts = F.lit(False)
        for k, c in enumerate(order):
            if _kind(df, c) == "text":
                texts = texts | (F.col("s.__k") == k)
        longer = texts & more & ~F.col("none")
        next_one = F.when(F.col("s.__k").isin(inexact), F.lit(ended)).otherwise(F.col("s.__k") + 1)
        full = full.where(F.col("n") > in_one_task).select(
            name,
            F.when(~F.col("s.__tied") | longer, F.col("s.__k")).otherwise(next_one).alias("__k"),
            F.when(~F.col("s.__tied"), F.col("s.__c")).when(longer, F.col("s.__c") + 1).otherwise(F.lit(0)).alias("__c"),
        )
        full = cut_lineage(full.where(F.col("__k") < ended))
        if full.isEmpty():
            return rows.drop("__k", "__c", "__tied")
        plain = rows.drop("__k", "__c", "__tied")
        inside = plain.join(broadcast_if_small(full), name)
        finite = F.when(~F.isnan("__d"), F.col("__d"))
        def cuts(v: Column) -> Column:
            """Quantiles, and the ends, which are exact: a value that ties all is found by them."""
            quantiles = F.coalesce(F.percentile_approx(v, probs, ACCURACY), F.array())
            return F.array_sort(F.array_distinct(F.concat(quantiles, F.array(F.min(v), F.max(v)))))

        edges = inside.withColumns({"__l": long, "__d": double}).groupBy(name, "__k", "__c").agg(
            cuts(F.col("__l")).alias("__le"), cuts(finite).alias("__de")
        )
        cut = rows.withColumnsRenamed({"__k": "__k0", "__c": "__c0", "__tied": "__t0"}).join(
            broadcast_if_small(cut_lineage(edges)), name, "left"
        )
        cut = cut.withColumns({"__l": long, "__d": double, "__none": missing})

        def place(edges: str, value: str) -> Column:
            below = F.size(F.filter(edges, lambda e: e < F.col(value)))
            return 2 * below + F.array_contains(edges, F.col(value)).cast("int") + 1

        at = F.when(F.col("__none"), F.lit(0)).when(F.isnan("__d"), F.lit(2 * EDGES + 8)).when(F.col("__d").isNotNull(), F.coalesce(place("__de", "__d"), F.lit(1))).otherwise(
            F.coalesce(place("__le", "__l"), F.lit(1))
        )
        split = F.col("__k").isNotNull()
        rows = cut_lineage(
            cut.withColumn("__at", at).select(
                *[quoted(c) for c in df.columns],
                F.when(split, F.concat(name, F.lpad(F.hex("__at"), 2, "0"))).otherwise(F.col(name)).alias(name),
                F.when(split, F.col("__k")).otherwise(F.lit(ended)).alias("__k"),
                F.coalesce("__c", F.lit(0)).alias("__c"),
                F.when(split, (F.col("__at") % 2 == 0)).otherwise(F.lit(False)).alias("__tied"),
            )
        )


def running_total(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    amount: Column,
    name: str,
    rows: int | None = None,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Add the sum of ``amount`` over all earlier rows of the partition (0 for the first).

    ``order`` must be a total order. ``rows`` is an upper bound of the rows of ``df``
    where the caller knows one.
    """
    before = Window.unboundedPreceding
    rows = df.count() if rows is None else rows
    if rows <= in_one_task:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(before, -1)
        return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    cut = split_ranges(df, order, in_one_task)
    keys = [*partition, "__range"]
    # One row per partition value and range.
    w = Window.partitionBy(*partition).orderBy("__range").rowsBetween(before, -1)
    starts = (
        cut.groupBy(*keys)
        .agg(F.sum(amount).alias("__sum"))
        .withColumn("__start", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
        .select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], "__start")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(before, -1)
    within = F.coalesce(F.sum(amount).over(inner), F.lit(0))
    return (
        cut.join(broadcast_if_small(starts), same, "inner")
        .withColumn(name, F.col("__start") + within)
        .select(*df.columns, name)
    )


def numbered(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """Add the zero-based row number within the partition."""
    return running_total(df, partition, order, F.lit(1), name, in_one_task=in_one_task)
