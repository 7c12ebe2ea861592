"""What code on Python workers needs: this package, shipped once for each context."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not any("tidewire-code" in f for f in context._python_includes):
        package = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(), "tidewire-code")
        context.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(package), "tidewire"))
