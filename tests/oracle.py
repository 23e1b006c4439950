"""Run a registered query in Spark and its SQL twin in DuckDB and compare them."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from panelflow.plans.derived import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in records)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string",
    "BOOLEAN": "boolean", "BLOB": "binary", "TIMESTAMP": "timestamp", "DATE": "date",
}


def difference(spark, con, sf_dir, query, sql):
    """None when both sides agree, else a short description."""
    frame = query(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    spark_types = dict(frame.dtypes)
    clash = {c: (spark_types[c], types[c]) for c in columns if spark_types[c] != types[c]}
    if clash:
        return f"types {clash}"
    if got != want:
        extra, missing = got - want, want - got
        return (f"rows {sum(got.values())} vs {sum(want.values())}; {got_columns}\n"
                f"  only spark {list(extra.items())[:3]}\n  only sql   {list(missing.items())[:3]}")
    if not got:
        return "both empty"
    return None
