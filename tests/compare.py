"""Holds queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return repr(x) if isinstance(x, (list, dict)) else x


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What is unlike between a DataFrame and a query's result, empty if nothing."""
    rows = con.execute(sql)
    theirs = [d[0] for d in rows.description]
    ours = df.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {ours} and {theirs}"
    names = sorted(ours)
    a = Counter(tuple(plain(v) for v in row) for row in zip(*(df_col for df_col in _columns(df, names)), strict=True))
    order = [theirs.index(n) for n in names]
    b = Counter(tuple(plain(row[i]) for i in order) for row in rows.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b).items())[:3]}; only SQL's {list((b - a).items())[:3]}"


def _columns(df, names):
    table = df.select(*names).toArrow()
    return [c.to_pylist() for c in table.columns]


if __name__ == "__main__":
    sys.path[:0] = [str(Path(__file__).resolve().parents[1])]
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *names = sys.argv[1:]
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.driver.maxResultSize", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con, bad = entry.queries(), entry.oracle_sql(), views(sf_dir), 0
    for name in names or [q for q in queries]:
        began = time.time()
        try:
            if name in sql:
                said = difference(queries[name](spark, sf_dir), con, sql[name])
            else:
                said = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
        spark.catalog.clearCache()
    sys.exit(bool(bad))
