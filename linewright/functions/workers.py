"""Running Python over Arrow batches where columns cannot say it, and broadcasts behind a check of their size."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a model table that may be broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *known])


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


class _Rows:
    def __init__(self, f, arrow, args):
        self.f, self.arrow, self.args = f, arrow, args

    def __call__(self, batches):
        for columns in self.f(batches, *self.args):
            yield pa.RecordBatch.from_arrays([_as(columns[x.name], x.type) for x in self.arrow], schema=self.arrow)


def map_batches(df: DataFrame, f: Callable[..., Iterator[dict]], ddl: str, *args) -> DataFrame:
    """mapInArrow with f(batches, *args), which yields dicts of columns."""
    reach_workers(df.sparkSession)
    schema = T.StructType.fromDDL(ddl)
    return df.mapInArrow(_Rows(f, to_arrow_schema(schema), args), schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has so few rows; else df, and Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
