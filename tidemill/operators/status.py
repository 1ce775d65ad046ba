"""Per-file facts, file status and run totals, all from block summaries.

A block summary has one row per (source_file, block): n_valid, n_reject,
n_cast_failures and, by lane, header_ts (text) or is_valid (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.spec import UNKNOWN_TS


def block_facts(blocks: DataFrame) -> DataFrame:
    """Give every block what its file settles: ingest_ts and whether the file loads.

    Works on the small summary only. Joining rows to it on (source_file, block) keeps
    every join group at one block, however large the file. Blocks without counts (`block_headers`)
    get no `loads`.
    """
    per_file = Window.partitionBy("source_file")
    if "header_ts" in blocks.columns:
        header = F.when(F.col("header_ts").isNotNull(), F.struct("block", "header_ts"))
        ingest_ts = F.min(header).over(per_file)["header_ts"]
    else:
        ingest_ts = F.lit(None).cast("string")
    facts = ["source_file", "block", ingest_ts.alias("ingest_ts")]
    if "n_valid" in blocks.columns:
        readable = F.bool_and("is_valid").over(per_file) if "is_valid" in blocks.columns else F.lit(True)
        facts.append((readable & (F.sum("n_valid").over(per_file) > 0)).alias("loads"))
    return blocks.select(*facts)


def attach_ingest_ts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Left-join the file's timestamp onto its rows; files without one get the unknown mark."""
    joined = rows.join(facts.select("source_file", "block", "ingest_ts"), ["source_file", "block"], "left")
    return joined.withColumn("ingest_ts", F.coalesce("ingest_ts", F.lit(UNKNOWN_TS)))


def file_status(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Counts and outcome per file: a file fails if unreadable or without a valid row.

    `files` (source_file) adds the files that produced no block at all, e.g. empty ones.
    """
    readable = F.bool_and("is_valid") if "is_valid" in blocks.columns else F.lit(True)
    counted = blocks.groupBy("source_file").agg(
        F.sum("n_valid").alias("n_valid"),
        F.sum("n_reject").alias("n_reject"),
        F.sum("n_cast_failures").alias("n_cast_failures"),
        readable.alias("readable"),
    )
    if files is not None:
        counted = files.select("source_file").join(counted, "source_file", "left")

    def kept(name: str) -> Column:
        # Rows of an unreadable file are never loaded, so they are not counted either.
        return F.when(F.col("readable"), F.col(name)).otherwise(F.lit(0)).cast("bigint").alias(name)

    status = F.when(F.col("readable") & (F.col("n_valid") > 0), "processed").otherwise("failed")
    return counted.select(
        "source_file", kept("n_valid"), kept("n_reject"), kept("n_cast_failures"), status.alias("status")
    )


def run_summary(status: DataFrame) -> DataFrame:
    """Totals of a load: files processed, files failed, records written."""
    done = F.col("status") == "processed"
    return status.agg(
        F.count_if(done).alias("files_processed"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.coalesce(F.sum(F.when(done, F.col("n_valid"))), F.lit(0)).alias("total_records"),
    )


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of an ingest: files processed, skipped, failed, from one status row per file."""
    return outcomes.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")]
    )
