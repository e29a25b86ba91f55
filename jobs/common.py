"""What the command lines of the jobs share: a settings file, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings_of(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """The JSON settings in a file over the defaults; unknown names are refused."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"{path} has settings that the job doesn't know: {', '.join(sorted(unknown))}")
    return {**defaults, **given}


def command_line(description: str, paths: list[str], config: str, defaults: dict[str, Any], work: Callable[..., object]) -> None:
    """Run `work(spark, *paths, settings)` from the command line: paths as arguments, settings from the file."""
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(name)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), config), help="JSON file of settings")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    settings = settings_of(given.config, defaults)
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        log.info("done: %s", work(spark, *[getattr(given, name) for name in paths], settings))
    finally:
        spark.stop()
