"""Python code on executors: the package goes along with the application."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to all Python workers of the application, once.

    Workers need not have it installed, nor share a folder with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(home.rglob("*.py")):
            out.write(f, f.relative_to(home.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
