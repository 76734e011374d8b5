"""Session helpers: local sessions for tests, and where shared scratch data goes."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tabwright") -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TABWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: there the
    driver's disk is the executors' disk.
    """
    setting = "spark.checkpoint.dir"
    named = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="tabwright-")
    spark.conf.set(setting, made)
    return made


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then neither recompute it nor depend on executors that may be
    lost.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_inside: list[str | None] = []


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go at once, not when the driver happens to collect garbage.

    For passes whose results are fetched. It holds for the whole session: a query that another
    thread runs meanwhile makes its shuffles again if it is run again.
    """
    with _lock:
        if not _inside:
            _inside.append(spark.conf.get(_FREED, None))
            spark.conf.set(_FREED, "true")
        else:
            _inside.append(None)
    try:
        yield
    finally:
        with _lock:
            if len(_inside) > 1:
                _inside.pop()
            elif (was := _inside.pop()) is None:
                spark.conf.unset(_FREED)
            else:
                spark.conf.set(_FREED, was)
