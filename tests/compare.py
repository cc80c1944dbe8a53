"""Runs registered queries on Spark and their SQL on DuckDB over the same tables and compares whole results.

``python tests/compare.py [SF_DIR] [NAME...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A comparable form: numbers to nine digits, arrays and structs to tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def difference(df, con, sql: str) -> str:
    """Empty when the results are equal, else what differs."""
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want, got = rows_of(columns, found.fetchall()), rows_of(df.columns, df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as E

    spark, con, queries, sql, bad = session(), duck(sf_dir), E.queries(), E.oracle_sql(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or queries:
        began = time.time()
        try:
            said = difference(queries[name](spark, sf_dir), con, sql[name]) if name in sql else f"# {queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001 - a report of all queries goes on
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said) and said[0] != "#"
        print(f"{'ok  ' if not said or said[0] == '#' else 'BAD '} {name} {time.time() - began:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
