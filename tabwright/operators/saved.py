"""Fitted learners as folders: a manifest and the Spark models under it, for any nesting."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from .crossfit import FittedSubspace
from .gram import LinearFit
from .models import Fitted
from .stacking import FittedStack, FittedVote

FORMAT = 1


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One line of JSON, written by Spark, so any folder that Spark reaches will do."""
    line = json.dumps({"format": FORMAT, **content})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    content = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if content["format"] != FORMAT:
        raise ValueError(f"{path} has format {content['format']}, this library reads {FORMAT}")
    return content


def save_learner(spark: SparkSession, fitted: object, path: str) -> None:
    """Write a fitted learner to a new folder; the manifest comes last."""

    def members(some: dict[str, object], name: str) -> list[str]:
        for i, x in enumerate(some.values()):
            save_learner(spark, x, f"{path}/{name}{i}")
        return list(some)

    if isinstance(fitted, Fitted):
        fitted.save(f"{path}/model")
        content = {"kind": "model", "task": fitted.task}
    elif isinstance(fitted, LinearFit):
        content = {"kind": "linear", "intercept": fitted.intercept, "coefficients": fitted.coefficients}
    elif isinstance(fitted, FittedSubspace):
        save_learner(spark, fitted.fitted, f"{path}/inner")
        content = {"kind": "subspace", "places": fitted.places}
    elif isinstance(fitted, FittedStack):
        content = {"kind": "stack", "base": members(fitted.base, "base"), "meta": members(fitted.meta, "meta"), "passed": fitted.passed}
    elif isinstance(fitted, FittedVote):
        content = {"kind": "vote", "fitted": members(fitted.fitted, "fitted"), "weights": fitted.weights}
    else:
        raise TypeError(f"cannot save {type(fitted).__name__}")
    write_manifest(spark, path, content)


def load_learner(spark: SparkSession, path: str) -> object:
    found = read_manifest(spark, path)

    def members(name: str) -> dict[str, object]:
        return {n: load_learner(spark, f"{path}/{name}{i}") for i, n in enumerate(found[name])}

    kind = found["kind"]
    if kind == "model":
        return Fitted(DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), found["task"])
    if kind == "linear":
        return LinearFit(found["intercept"], found["coefficients"])
    if kind == "subspace":
        return FittedSubspace(load_learner(spark, f"{path}/inner"), found["places"])
    if kind == "stack":
        return FittedStack(members("base"), members("meta"), found["passed"])
    if kind == "vote":
        return FittedVote(members("fitted"), found["weights"])
    raise ValueError(f"unknown kind {kind}")
