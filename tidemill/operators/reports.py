"""Reports over the dated tables: counts, sums, lineage, listings and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import on_or_after


def count_all(rows: DataFrame, name: str = "total_events") -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def count_by(rows: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    """Rows per key, most frequent first."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def total_by(
    rows: DataFrame, key: str, value: str, total: str = "total_attendance", name: str = "events", by: str | None = None
) -> DataFrame:
    """Sum and rows per key, largest `by` (default: the sum) first.

    Added up in 38 digits, so no order of rows can make it wrap; a sum beyond 64 bits is null.
    """
    exact = F.sum(F.col(value).cast("decimal(19,0)")).try_cast("bigint")
    return (
        rows.groupBy(key)
        .agg(exact.alias(total), F.count("*").alias(name))
        .orderBy(F.desc(by or total), key)
    )


def lineage(rows: DataFrame) -> DataFrame:
    """Per source file and load time: rows, first and last day."""
    return (
        rows.groupBy("source_file", "ingest_ts")
        .agg(
            F.count("*").alias("records"),
            F.min("event_date").alias("earliest_event"),
            F.max("event_date").alias("latest_event"),
        )
        .orderBy("source_file", "ingest_ts")
    )


def listing(
    rows: DataFrame,
    columns: Sequence[str],
    where: Column | None = None,
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Chosen columns of the matching rows, sorted and cut if asked.

    Ties in `order` should be broken by unique trailing keys; these may lie outside
    `columns`. Sort plus limit runs as one bounded top-k, never a full sort.
    """
    found = rows if where is None else rows.where(where)
    if order:
        found = found.orderBy(*order)
    if limit is not None:
        found = found.limit(limit)
    return found.select(*columns)


def upcoming(
    rows: DataFrame,
    as_of: Column,
    columns: Sequence[str],
    where: Column | None = None,
    order: Sequence[str] = ("event_date", "event_id", "source_file"),
    limit: int = 20,
) -> DataFrame:
    """Next events from a day on; the day filter prunes table partitions."""
    from_day = on_or_after(F.col("event_date"), as_of)
    return listing(rows, columns, from_day if where is None else where & from_day, order, limit)


def compare_counts(lanes: dict[str, DataFrame]) -> DataFrame:
    """One row count per named lane."""
    counted = [
        rows.agg(F.count("*").alias("records")).select(F.lit(name).alias("pipeline"), "records")
        for name, rows in lanes.items()
    ]
    combined = counted[0]
    for more in counted[1:]:
        combined = combined.unionByName(more)
    return combined
