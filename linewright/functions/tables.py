"""Tables that are needed more than once, written to the folder that driver and executors share.

They cut lineage, are computed once and outlive lost executors. They go when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linewright-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nobody uses; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/linewright-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df as a table of its own; the shuffle files behind it are removed at once."""
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
