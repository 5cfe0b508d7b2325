"""Gives the package to Python workers that can't import it, once a Spark application."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package as a zip by SparkContext.addPyFile; Spark's file server hands it to every executor."""
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already imported from a zip
        return
    sc = spark.sparkContext
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(here) for f in names if f.endswith(".py"))
    content = [(os.path.relpath(f, os.path.dirname(here)), open(f, "rb").read()) for f in files]
    digest = hashlib.sha256(repr(content).encode()).hexdigest()[:12]
    key = (sc.applicationId, digest)
    if any(k[0] == sc.applicationId for k in _shipped):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"loomrank-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, data in content:
            z.writestr(name, data)
    sc.addPyFile(path)
    _shipped.add(key)
