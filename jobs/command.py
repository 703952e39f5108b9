"""What the command lines of all jobs share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from cadence.session import configured


def settings(kind: type, path: str | None) -> Any:
    """``kind`` from a small file of JSON on the driver; names that it does not have raise, missing ones keep their defaults."""
    given = json.loads(Path(path).read_text()) if path else {}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def start(name: str, kind: type, run: Callable[..., dict], paths: dict[str, str], args: list[str] | None = None) -> dict:
    """Parses the paths and the configuration's path, runs the job in a session of its own and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="a file of JSON with settings")
    given = vars(parser.parse_args(args))
    config = settings(kind, given.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = configured(SparkSession.builder.appName(name)).getOrCreate()
    try:
        return run(spark, **given, config=config)
    finally:
        spark.stop()
