"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_textkeel_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="textkeel-"), "textkeel.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("textkeel", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    setattr(sc, _MARK, True)
