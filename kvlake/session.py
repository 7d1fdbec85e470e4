"""Session helpers: a local session for tests and benches, and the package for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that their Python finds it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="kvlake-"), "kvlake_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([*top.glob("kvlake/**/*.py"), *top.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(top))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kvlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
