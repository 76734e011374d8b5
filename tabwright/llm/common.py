"""What several text operators share.

Rows of ``documents`` are told apart by ``doc_id`` together with a hash of the text:
rows equal in both are one document, so repeated rows get equal results.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def whole_texts(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` and the text as ``__text``, null as the empty text."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))


def text_hash(column: str = "text") -> Column:
    """Hash of a text that tells rows with the same id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task, encodes: bool = False) -> Task:
    """``run``, after which the worker gives memory that is free back to the system.

    Spark keeps its Python workers for the next stages, and what one of them held at its
    peak would count against the executor from then on. Tasks that do not encode tokens
    first let go of what earlier ones remember for it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import forget

        if not encodes:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not glibc

    return wrapped


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the application, once.

    Spark's own file server distributes the archive, so the executors need no folder
    in common with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tabwright-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
