"""Ordered user functions per stage: ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass
class StageHooks:
    """Functions by stage, the highest priority first, equal ones in order of registration."""

    steps: dict[str, list[tuple[int, Step]]] = field(default_factory=dict)
    errors: list[tuple[str, str, str]] = field(default_factory=list)

    def register(self, stage: str, step: Step, priority: int = 0) -> None:
        listed = self.steps.setdefault(stage, [])
        listed.append((priority, step))
        listed.sort(key=lambda item: -item[0])

    def apply(self, stage: str, df: DataFrame) -> DataFrame:
        """Apply the stage's functions; one that fails to plan is recorded and skipped."""
        for _, step in self.steps.get(stage, []):
            try:
                changed = df.transform(step)
            except Exception as problem:  # a user function may raise anything
                self.errors.append((stage, getattr(step, "__name__", "step"), str(problem)))
                continue
            df = changed
        return df
