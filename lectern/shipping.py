"""Sends this repository's packages to the tasks, wherever the driver was started."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PACKAGES = ("lectern", "workload")


@functools.cache
def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-code-"), "lectern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for package in PACKAGES:
            for folder, _, files in os.walk(os.path.join(ROOT, package)):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, ROOT))
    return path


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after its tasks were given the packages once."""
    context = spark.sparkContext
    if not getattr(context, "_lectern_shipped", False):
        context.addPyFile(_archive())
        context._lectern_shipped = True
    return spark
