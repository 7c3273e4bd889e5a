"""What a session needs for this package: its place on the workers' path, and Arrow batches of bounded size."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, about, where the session sets none: rows with long texts make batches of few rows.
BATCH_BYTES = 4 << 20
#: Tasks a core that ``spread`` makes.
WAVES = 4


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the path of Python workers that start from now on.

    It helps where workers see the driver's folders (local mode, shared installs); elsewhere the package
    is installed or sent with --py-files, and the entry is without effect. Arrow batches get a limit in bytes,
    unless the session has its own.
    """
    home, own = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        own["PYTHONPATH"] = os.pathsep.join([home, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to several tasks a core. A small file of many compact rows is read by one or two tasks; work on them
    that takes long a row, or makes many of one, then has only these."""
    return rows.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")
