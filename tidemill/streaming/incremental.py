"""Incremental loading: the stream says when the listing has changed, each micro-batch loads what is new."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.plans.load import Lane, Store, archive_processed, batches, pending_files, report_hidden, run_files
from tidemill.sources import landing, paths
from tidemill.sources.files import directly_in

_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def file_listings(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """Stream of (source_file, path, length): the directory's files as they are when the listing changes.

    One batch comes with each start, so that files which failed are tried again. Where Python's
    workers cannot reach the storage, the stream is Spark's own: new files alone, and without the names
    that Spark's sources pass over.
    """
    where = paths.qualified(spark, directory)
    if landing.reachable(where):
        return landing.listings(spark, where, pattern, uuid.uuid4().hex)
    found = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("pathGlobFilter", pattern)
        .option("fileNameOnly", "true")
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", "36500d")
        .load(directory)
        .where(directly_in(spark, directory))
    )
    return found.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "path", "length")


def load_new(
    spark: SparkSession,
    directory: str,
    lane: Lane,
    table: str,
    store: Store,
    checkpoint: str,
    run_ts: str,
    max_files: int = 1_000,
    archive: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Load all files not loaded yet in bounded batches, then stop, or go on as `trigger` says.

    A micro-batch is a listing; the ledger tells what of it is new. A file changed under a known name
    does not come again, no file is too old, folders below are not looked into. A micro-batch that is
    repeated after a failure skips the files already processed and completes a half-written append
    rather than doubling it. Bad files end up in the status table, do not hold up the others and are
    tried again by the next start. With `archive`, files move there as soon as they are marked.
    """

    # Batch numbers start anew with each checkpoint, so that is part of the run's name.
    stream = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def load_batch(listing: DataFrame, batch_id: int) -> None:
        session = listing.sparkSession
        for number, found in enumerate(batches(pending_files(session, listing, store), max_files)):
            store.tidy(session)
            run_files(session, found, lane, table, store, f"{stream}-{batch_id}-{number}", run_ts)
        report_hidden(session, directory, lane, store, f"{stream}-{batch_id}-hidden")
        if archive:
            archive_processed(session, directory, lane, store, archive, max_files=max_files)

    return (
        file_listings(spark, directory, lane.pattern)
        .writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
