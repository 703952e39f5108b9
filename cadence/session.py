"""The session settings the operators rely on, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Civil time is computed on NTZ timestamps, so the session's own zone has to be UTC.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under spark.checkpoint.dir, which driver and executors share; only where that is unset, as in local tests, under a folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cadence-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
