"""Property-graph analytics on PySpark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder the driver has it in.

    On a cluster where that folder is not shared, install the package or pass it with --py-files.
    """
    top = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    if top not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [top, environment.get("PYTHONPATH", "")]))
