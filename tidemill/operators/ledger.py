"""The ledger of files: (stage, source_file, ts, run_id), one row per file and stage passed.

Joins here are between file lists, never between rows of data, and carry no hint:
Spark broadcasts a side only when its measured size is under the session's threshold
and shuffles by file name, which is unique per list, otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import strip
from tidemill.spec import LEDGER_SEPARATOR, UNKNOWN_TS

SCHEMA = "stage string, source_file string, ts string, run_id string"


def names_from_log(lines: DataFrame) -> DataFrame:
    """Distinct file names of a one-name-per-line log; blank lines do not count."""
    return (
        lines.select(strip(F.col("value")).alias("source_file")).where(F.col("source_file") != "").distinct()
    )


def timestamps_from_log(lines: DataFrame, plain_counts: bool) -> DataFrame:
    """(source_file, ts) of a `name|timestamp` log; the last line of a file wins.

    A line without separator either counts as seen at an unknown time (`plain_counts`,
    the ingest reading) or is dropped (the transform reading).
    """
    parts = F.split(F.col("entry"), "\\" + LEDGER_SEPARATOR, 2)
    entries = lines.select(strip(F.col("value")).alias("entry"), "block", "line_no").where(F.col("entry") != "")
    if not plain_counts:
        entries = entries.where(F.col("entry").contains(LEDGER_SEPARATOR))
    return (
        entries.select(
            parts[0].alias("source_file"),
            F.coalesce(F.get(parts, F.lit(1)), F.lit(UNKNOWN_TS)).alias("ts"),
            F.struct("block", "line_no").alias("place"),
        )
        .groupBy("source_file")
        .agg(F.max_by("ts", "place").alias("ts"))
    )


def at_stage(ledger: DataFrame, stage: str) -> DataFrame:
    return ledger.where(F.col("stage") == stage)


def unseen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name is not in the ledger."""
    return files.join(ledger.select("source_file"), "source_file", "left_anti")


def seen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name is in the ledger."""
    return files.join(ledger.select("source_file"), "source_file", "left_semi")


def backlog(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Files past the earlier stage but not the later one."""
    return unseen(earlier.select("source_file").distinct(), later)


def with_ts(files: DataFrame, timestamps: DataFrame) -> DataFrame:
    """Add each file's ledger timestamp, or the unknown mark."""
    found = files.join(timestamps.select("source_file", F.col("ts").alias("ingest_ts")), "source_file", "left")
    return found.withColumn("ingest_ts", F.coalesce("ingest_ts", F.lit(UNKNOWN_TS)))


def entries(files: DataFrame, stage: str, ts: str | Column, run_id: str) -> DataFrame:
    """Ledger rows for `files` (source_file)."""
    at = F.lit(ts) if isinstance(ts, str) else ts
    return files.select(
        F.lit(stage).alias("stage"), "source_file", at.alias("ts"), F.lit(run_id).alias("run_id")
    )
