"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows that Spark hands to Python at once, unless the session says otherwise.
ROWS_PER_BATCH = 2000


def ship(spark: SparkSession) -> None:
    """Make a session ready for this package's Python steps.

    A zip of the package's modules is added to the session's context, once; Spark hands it to every executor. Rows come
    in batches of ROWS_PER_BATCH where the session has Spark's default of 10,000, which texts make too large.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default; texts are long rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(target)
    context._lodestone_shipped = True
