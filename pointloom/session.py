"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this checkout import the package from it.

    This changes the caller's session: the workers' environment (search path, memory given
    back) and, where it has the default value, the size of Arrow batches.
    Clusters without a shared checkout ship the package with --py-files instead.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
        # workers give freed memory back instead of keeping their peak
        spark.sparkContext.environment.update(MALLOC_TRIM_THRESHOLD_="1048576", MALLOC_MMAP_THRESHOLD_="1048576", ARROW_DEFAULT_MEMORY_POOL="system")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows may be long texts
    return spark


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only where that setting is absent and all runs on this machine, as in tests, a folder
    of this machine is made; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    ours = f"{base.rstrip('/')}/pointloom-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ours)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{ours}/{uuid.uuid4().hex}"
