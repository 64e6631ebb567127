"""Shared helpers: reading tables, writing intermediate tables to the shared folder, running Python over Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: One word: whatever stands between ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linewright-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors.

    drop() deletes a table as soon as nothing needs it; what a returned DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/linewright-{uuid.uuid4().hex}"
        self.names: dict[int, str] = {}
        self.n = 0
        atexit.register(_delete, spark, self.at)

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        # what was shuffled for the table is of no use once it stands
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.names[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, df._scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Drops all that has been saved but these; nothing that is still to run may read the others."""
        kept = {df._scratch_path for df in tables}
        for n in range(1, self.n + 1):
            if (path := f"{self.at}/{n}") not in kept:
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone: the folder's owner cleans up
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def reach_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it."""
    here = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if not isinstance(ddl, T.StructType) else ddl


def map_arrow(df: DataFrame, f: Callable[..., Iterator[dict]], ddl: str, *args) -> DataFrame:
    """mapInArrow with f(batches, *args) yielding dicts of columns; args travel with the task."""
    spark = df.sparkSession
    reach_workers(spark)
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(_Mapped(f, arrow, args), schema)


class _Mapped:
    def __init__(self, f, arrow, args):
        self.f, self.arrow, self.args = f, arrow, args

    def __call__(self, batches):
        for cols in self.f(batches, *self.args):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for t, c in zip(self.arrow, (cols[t.name] for t in self.arrow))], schema=self.arrow)


def pieces(batches, step: int = 500):
    """Arrow batches in runs of at most step rows, so that what a run holds stays small."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
