"""Run a query and its SQL counterpart and compare them as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    return sorted(columns), rows


def spark_rows(spark, sf_dir: str, name: str) -> tuple[list[str], Counter]:
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    return columns, Counter(tuple(row) for row in df.select(*columns).collect())


def difference(spark, sf_dir: str, name: str) -> str | None:
    """None if equal, else a short account of what differs."""
    expected_columns, expected = sql_rows(sf_dir, entry.oracle_sql()[name])
    columns, found = spark_rows(spark, sf_dir, name)
    if columns != expected_columns:
        return f"columns {columns} instead of {expected_columns}"
    if not expected:
        return "the SQL returns no rows"
    if found != expected:
        missing, extra = list((expected - found).items())[:3], list((found - expected).items())[:3]
        return f"{found.total()} rows, {expected.total()} expected; missing {missing}; extra {extra}"
    return None
