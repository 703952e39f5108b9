"""What a run has read and made, counted while its plan runs, and what it was set to."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cadence.sources.sinks import ALGORITHM

SCHEMA = "run string, kind string, stage string, name string, value string"


class RunLog:
    """Counts by stage from Spark's observations, which need no job of their own; settings and errors beside them.

    A stage is watched where its rows pass; its counts are there when an action
    over them has ended. A stage whose rows the plan has found to be none has
    no counts.
    """

    def __init__(self, spark: SparkSession, **settings: object) -> None:
        self.spark, self.run = spark, uuid.uuid4().hex
        self._settings = {"algorithm": ALGORITHM} | settings
        self._watched: dict[str, Observation] = {}
        self._errors: list[tuple[str, str]] = []

    def watch(self, rows: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """``rows``; on their way their number and ``measures`` (aggregates) are counted."""
        if stage in self._watched:
            raise ValueError(f"stage {stage} is watched already")
        self._watched[stage] = Observation(f"{stage}-{self.run}")
        return rows.observe(self._watched[stage], F.count(F.lit(1)).alias("rows"), *(v.alias(k) for k, v in measures.items()))

    def failed(self, stage: str, error: Exception) -> None:
        self._errors.append((stage, f"{type(error).__name__}: {error}"))

    def counts(self, stage: str) -> dict[str, object]:
        """Of a watched stage after an action."""
        try:
            return self._watched[stage].get
        except (Py4JJavaError, AssertionError):
            return {}

    def table(self) -> DataFrame:
        """(run, kind, stage, name, value as text): settings, counts and errors; call it after the run's actions, and write it beside what they made."""
        rows = [("setting", None, k, v) for k, v in self._settings.items()] + [("error", stage, "error", e) for stage, e in self._errors]
        done = [] if self._errors else self._watched  # observations of a failed action never come
        rows += [("count", stage, k, v) for stage in done for k, v in self.counts(stage).items()]
        return self.spark.createDataFrame([(self.run, kind, stage, name, None if v is None else str(v)) for kind, stage, name, v in rows], SCHEMA)
