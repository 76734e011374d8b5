"""Decide by measuring: only a table whose size was checked is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_ROWS = 500_000
MAX_BYTES = 32 << 20
_VALUE_BYTES = 8


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: the lengths of texts and eight for every other value."""
    size = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
        size = size + F.lit(_VALUE_BYTES)
    return size


def settle(
    table: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> tuple[DataFrame, bool]:
    """``table`` computed once, and whether it is small.

    It is written to the shared folder; rows and bytes are aggregated over what was
    written. Only if both are within their bounds it is fetched, as a literal.
    """
    written = cut_lineage(table)
    if max_rows < 1:
        return written, False
    size = written.agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes(written)).alias("b")).first()
    if size["n"] > max_rows or (size["b"] or 0) > max_bytes:
        return written, False
    return table.sparkSession.createDataFrame(written.toArrow(), schema=table.schema), True


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``table`` computed once, with a broadcast hint if it was measured to be small."""
    kept, small = settle(table, max_rows)
    return F.broadcast(kept) if small else kept
