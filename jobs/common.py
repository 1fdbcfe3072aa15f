"""What the jobs share: their settings file, their log and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(kind: type, given: dict):
    """A settings object; names that it doesn't have and missing ones without a default are refused."""
    names = {f.name for f in fields(kind)}
    if unknown := set(given) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def main(name: str, kind: type, run: Callable) -> None:
    """The command line: a JSON file of settings and key=value pairs that overrule it."""
    p = argparse.ArgumentParser(prog=f"jobs.{name}")
    p.add_argument("config", help="JSON file of settings")
    p.add_argument("overrule", nargs="*", help="key=value")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        given = json.load(f)
    for pair in args.overrule:
        key, _, value = pair.partition("=")
        given[key] = type(given[key])(value) if isinstance(given.get(key), int) else value
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, settings(kind, given))
    finally:
        spark.stop()
