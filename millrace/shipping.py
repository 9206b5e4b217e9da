"""Sends this package to the workers of a session whose machines don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's modules, which Spark serves to the workers."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
