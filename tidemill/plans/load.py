"""Files into the dated table, once each, however often a run is interrupted.

State lives in three folders next to the table: the ledger, one status row per file and run, and
the rejected lines or elements. A load notes its files as `started`,
appends their rows and only then notes them as `processed`. A rerun therefore knows
which files may be in the table in part, and for just those appends only what is missing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import strip
from tidemill.operators import documents, labeled, ledger, status
from tidemill.session import materialize, pin_splits, require_settings, scratch_dir
from tidemill.sources import files as sources
from tidemill.sources import landing, paths
from tidemill.sources.ledger_files import LedgerFiles
from tidemill.sources.tables import append_sampled, missing_rows, state_folder
from tidemill.spec import JSON_PATTERN, JSON_RECORD, TEXT_PATTERN, TEXT_RECORD, UNKNOWN_TS, RecordSpec

INGESTED, STARTED, PROCESSED = "ingested", "started", "processed"
STATUS_SCHEMA = (
    "source_file string, n_valid bigint, n_reject bigint, n_cast_failures bigint, status string, run_id string"
)
REJECT_SCHEMA = "source_file string, preview string, reason string, run_id string"
_PLACE = ["source_file", "block"]


@dataclass(frozen=True)
class Lane:
    """How one kind of file is read and taken apart."""

    name: str
    spec: RecordSpec
    pattern: str
    raw_columns: str
    read: Callable[[SparkSession, list[tuple[str, int]]], DataFrame]
    prepare: Callable[[DataFrame], DataFrame]
    summarize: Callable[[DataFrame], DataFrame]
    records: Callable[..., DataFrame]
    rejects: Callable[[DataFrame], DataFrame]
    costly: Callable[[list[tuple[str, int]]], bool]  # reading these files again costs more than keeping them
    sample: int  # rows of a load that are kept to be looked at
    written: bool  # what `prepare` works out is written down for the passes of a load


TEXT = Lane(
    name="text",
    spec=TEXT_RECORD,
    pattern=TEXT_PATTERN,
    raw_columns="source_file string, block bigint, line_no bigint, value string",
    read=sources.read_listed,
    prepare=labeled.parsed,
    summarize=labeled.parsed_summary,
    records=labeled.parsed_records,
    rejects=labeled.parsed_rejects,
    costly=lambda found: False,
    sample=3,
    written=True,
)

JSON = Lane(
    name="json",
    spec=JSON_RECORD,
    pattern=JSON_PATTERN,
    raw_columns="source_file string, block bigint, chunk bigint, items array<variant>",
    read=sources.read_documents,
    prepare=lambda frame: frame,
    summarize=documents.block_summary,
    records=documents.records,
    rejects=documents.rejects,
    costly=lambda found: any(length > sources.WHOLE_DOCUMENT_BYTES for _, length in found),
    sample=2,
    written=False,
)


def _sample_schema(spec: RecordSpec) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in spec.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in spec.data_columns)


@contextmanager
def _contents(spark: SparkSession, lane: Lane, found: list[tuple[str, int]]) -> Iterator[DataFrame]:
    """What the files hold. Cutting up large JSON files takes shuffles, so that is done
    once per load and kept on the executors' disks; what is lost is worked out again."""
    frame = lane.read(spark, found)
    if not lane.costly(found):
        yield frame
        return
    frame = frame.persist(StorageLevel.DISK_ONLY)
    try:
        yield frame
    finally:
        frame.unpersist()


@contextmanager
def _prepared(frame: DataFrame, lane: Lane) -> Iterator[DataFrame]:
    """What the lane's operators take. Lines are taken apart once per load and written down, in
    fewer bytes than they come in, until the load ends."""
    if not lane.written:
        yield lane.prepare(frame)
        return
    spark = frame.sparkSession
    folder, worked_out = scratch_dir(spark, f"{lane.name}-parsed"), lane.prepare(frame)
    try:
        worked_out.write.parquet(folder)
        yield spark.read.schema(worked_out.schema).parquet(folder)
    finally:
        paths.remove(spark, folder)


@dataclass(frozen=True)
class Store:
    """The state folders of one lane, on storage every executor reaches."""

    root: str

    @property
    def entries(self) -> LedgerFiles:
        return LedgerFiles(f"{self.root}/ledger")

    def ledger(self, spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
        """All ledger rows; with `names` (source_file) those of their buckets, which hold all of theirs."""
        return self.entries.read(spark, names)

    def status(self, spark: SparkSession, run_ids: list[str] | None = None) -> DataFrame:
        """Status rows of all runs, or of the runs named, whose folders alone are opened then."""
        if run_ids is None:
            return state_folder(spark, f"{self.root}/status", STATUS_SCHEMA, "run_id")
        if not run_ids:
            return spark.createDataFrame([], STATUS_SCHEMA)
        reader = spark.read.schema(STATUS_SCHEMA).option("basePath", f"{self.root}/status")
        return reader.parquet(*[f"{self.root}/status/run_id={run_id}" for run_id in run_ids])

    def rejects(self, spark: SparkSession) -> DataFrame:
        return state_folder(spark, f"{self.root}/rejects", REJECT_SCHEMA, "run_id")

    def mark(self, names: DataFrame, stage: str, ts: str, run_id: str) -> None:
        """Append one ledger row per name, as few files."""
        self.entries.append(ledger.entries(names, stage, ts, run_id))

    def sample(self, spark: SparkSession, spec: RecordSpec) -> DataFrame:
        """Rows kept of each run, with the run's id."""
        return state_folder(spark, f"{self.root}/sample", _sample_schema(spec) + ", run_id string", "run_id")

    def put_sample(self, spark: SparkSession, rows: list[Row], spec: RecordSpec, run_id: str) -> None:
        """Keep the few rows that the write pass has picked."""
        picked = [tuple(row[c] for c in spec.data_columns) for row in rows]
        self.put("sample", spark.createDataFrame(picked, _sample_schema(spec)).coalesce(1), run_id)

    def tidy(self, spark: SparkSession) -> None:
        """Merge what recent runs have added to the ledger, if it is much."""
        self.entries.merge(spark)

    def put(self, kind: str, rows: DataFrame, run_id: str) -> None:
        """Replace this run's rows of `kind`, so that repeating a run repeats nothing."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/run_id={run_id}")


def load_frame(
    frame: DataFrame,
    names: DataFrame,
    lane: Lane,
    table: str,
    store: Store,
    run_id: str,
    run_ts: str,
) -> DataFrame:
    """Load the files `names` (source_file), whose contents are `frame`; returns their status.

    Two passes over the contents: a light one that counts per block and finds headers,
    and the one that writes. The light pass is what allows a file without a
    valid row to be left out and lets the timestamp join be as small as the file list.
    """
    require_settings(frame.sparkSession)
    pin_splits(frame.sparkSession)
    with _prepared(frame, lane) as lines:
        return _load(lines, names, lane, table, store, run_id, run_ts)


def _load(
    frame: DataFrame,
    names: DataFrame,
    lane: Lane,
    table: str,
    store: Store,
    run_id: str,
    run_ts: str,
) -> DataFrame:
    """`load_frame` of a prepared frame."""
    spark = frame.sparkSession
    entries = store.ledger(spark, names)
    blocks = materialize(lane.summarize(frame), f"{lane.name}-blocks")
    ingested = ledger.at_stage(entries, INGESTED).groupBy("source_file").agg(F.max("ts").alias("ledger_ts"))
    facts = (
        status.block_facts(blocks)
        .join(ingested, "source_file", "left")
        .withColumn("ingest_ts", F.coalesce("ingest_ts", "ledger_ts", F.lit(UNKNOWN_TS)))
        .drop("ledger_ts")
    )
    facts = materialize(facts, f"{lane.name}-facts")
    loading = facts.where("loads")
    store.put("status", status.file_status(blocks, names), run_id)
    outcome = store.status(spark, [run_id])
    totals = outcome.agg(
        F.count_if(F.col("status") == "processed").alias("files"),
        F.sum("n_valid").alias("rows"),
        F.sum("n_reject").alias("rejected"),
    ).first()
    if totals["files"]:
        started = ledger.backlog(ledger.at_stage(entries, STARTED), ledger.at_stage(entries, PROCESSED))
        loading_names = loading.select("source_file").distinct()
        doubtful = materialize(ledger.seen(loading_names, started), f"{lane.name}-doubtful")
        any_doubt = not doubtful.isEmpty()
        store.mark(loading_names, STARTED, run_ts, run_id)
        expected = totals["rows"]
        placed = frame.join(loading.select(*_PLACE, "ingest_ts"), _PLACE)
        if any_doubt:
            sure = lane.records(ledger.unseen(placed, doubtful), keep=("ingest_ts",))
            unsure = lane.records(ledger.seen(placed, doubtful))
            file_ts = loading.select("source_file", "ingest_ts").distinct()
            missing = materialize(missing_rows(unsure, table, lane.spec).join(file_ts, "source_file"), "missing")
            sure_rows = ledger.unseen(outcome.where("status = 'processed'"), doubtful).agg(F.sum("n_valid")).first()[0]
            expected = (sure_rows or 0) + missing.count()
            rows = sure.select(*missing.columns).unionByName(missing)
        else:
            rows = lane.records(placed, keep=("ingest_ts",))
        written, shown = append_sampled(rows.withColumn("processing_ts", F.lit(run_ts)), table, lane.spec, lane.sample)
        store.put_sample(spark, shown, lane.spec, run_id)
        if written != expected:
            # Left as started, so the next run adds what is missing.
            raise RuntimeError(f"{lane.name} run {run_id}: {written} rows written, {expected} counted")
    if totals["rejected"]:
        with_rejects = blocks.where("n_reject > 0").select(*_PLACE)
        if "is_valid" in blocks.columns:
            unreadable = blocks.where(~F.col("is_valid")).select("source_file").distinct()
            with_rejects = ledger.unseen(with_rejects, unreadable)
        refused = frame.join(with_rejects, _PLACE, "left_semi")
        store.put("rejects", lane.rejects(refused), run_id)
    if totals["files"]:
        store.mark(loading.select("source_file").distinct(), PROCESSED, run_ts, run_id)
    return outcome


def _names(spark: SparkSession, found: list[tuple[str, int]]) -> DataFrame:
    rows = [(path.rstrip("/").rsplit("/", 1)[-1],) for path, _ in found]
    return spark.createDataFrame(rows, "source_file string")


def _fail(spark: SparkSession, found: list[tuple[str, int]], store: Store, run_id: str) -> None:
    rows = _names(spark, found).select(
        "source_file", *[F.lit(0).cast("bigint").alias(n) for n in ("n_valid", "n_reject", "n_cast_failures")], F.lit("failed").alias("status")
    )
    store.put("status", rows, run_id)


def _unreadable(error: Exception) -> bool:
    """Whether a job ended because a file could not be read, rather than for what it does or writes."""
    text = str(error)
    return "FAILED_READ_FILE" in text or landing.UNREADABLE in text


def isolate(
    found: list[tuple[str, int]],
    run_id: str,
    load: Callable[[list[tuple[str, int]], str], None],
    fail: Callable[[list[tuple[str, int]], str], None],
) -> list[str]:
    """Load listed files, whatever some of them are like; returns the ids of the runs it took.

    A batch that ends in a read error is split: the files the error names fail and the rest is one
    batch; where it names none of them, the halves are loaded one after the other, down to the file.
    So k bad files take k more loads, or 2 k log2(n) at most, and what loads stays loaded.
    """
    todo, done = [(found, run_id)], []
    while todo:
        batch, own = todo.pop()
        try:
            load(batch, own)
            done.append(own)
            continue
        except Exception as error:
            if not _unreadable(error):
                raise
            text = str(error)
        named = [f for f in batch if _is_named(f[0], text)]
        if len(batch) == 1 or len(named) == len(batch):
            fail(batch, own)
            done.append(own)
        elif named:
            fail(named, f"{own}-f")
            done.append(f"{own}-f")
            todo.append(([f for f in batch if f not in named], f"{own}-r"))
        else:
            middle = len(batch) // 2
            todo += [(batch[middle:], f"{own}-b"), (batch[:middle], f"{own}-a")]
    return done


def _is_named(path: str, text: str) -> bool:
    """Whether a message names a path, as it is or URL-encoded, and not just as the beginning of another."""
    scheme = path.split(":", 1)[0] + ":" if ":" in path.split("/", 1)[0] else ""
    spelled = {path, scheme + quote(path.removeprefix(scheme), safe="/!$&'()*+,;=:@~-._")}
    return any(re.search(re.escape(p) + r"(?![^\s:.,\"')\]]|\.\w)", text) for p in spelled if p in text)


def run_files(
    spark: SparkSession, found: list[tuple[str, int]], lane: Lane, table: str, store: Store, run_id: str, run_ts: str
) -> list[str]:
    """Load listed (path, length) files; those already processed are left alone. Returns the run ids used."""
    names = _names(spark, found)
    done = ledger.seen(names, ledger.at_stage(store.ledger(spark, names), PROCESSED)).distinct()
    skip = {row["source_file"] for row in done.collect()}  # at most the files of this call
    found = [(path, length) for path, length in found if path.rsplit("/", 1)[-1] not in skip]

    def load(batch: list[tuple[str, int]], own: str) -> None:
        names = _names(spark, batch)
        try:
            with _contents(spark, lane, batch) as frame:
                load_frame(frame, names, lane, table, store, own, run_ts)
            return
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        # Some went after they were listed: they fail, the others load.
        left = sources.existing(spark, batch)
        if not left:
            _fail(spark, batch, store, own)
            return
        with _contents(spark, lane, left) as frame:
            load_frame(frame, names, lane, table, store, own, run_ts)

    return isolate(found, run_id, load, lambda batch, own: _fail(spark, batch, store, own)) if found else []


def load_files(
    spark: SparkSession, found: list[tuple[str, int]], lane: Lane, table: str, store: Store, run_id: str, run_ts: str
) -> DataFrame | None:
    """Load listed (path, length) files; the status of those not processed before, None if all were."""
    used = run_files(spark, found, lane, table, store, run_id, run_ts)
    return store.status(spark, used) if used else None


def archive_processed(spark: SparkSession, directory: str, lane: Lane, store: Store, archive: str, stage: str = PROCESSED, max_files: int = 10_000) -> int:
    """Move the files of `directory` that are past `stage` into `archive`; returns how many.

    What the ledger says decides, not what a run remembers: a file whose mark is there and whose move
    is not, for a run died between the two, goes with the next call. Others stay. A file of the same
    name in the archive is replaced.
    """
    listed = sources.list_files(spark, directory, lane.pattern)
    done = ledger.at_stage(store.ledger(spark, listed.select("source_file")), stage)
    return sum(paths.move_into(spark, path, archive) for batch in batches(ledger.seen(listed, done), max_files) for path, _ in batch)


def report_hidden(spark: SparkSession, directory: str, lane: Lane, store: Store, run_id: str) -> None:
    """Note files as skipped that neither Spark's sources nor Python's workers can read; see sources.files."""
    names = sources.hidden_files(spark, directory, lane.pattern)
    if names:
        rows = [(name, 0, 0, 0, "skipped") for name in names]
        columns = "source_file string, n_valid bigint, n_reject bigint, n_cast_failures bigint, status string"
        store.put("status", spark.createDataFrame(rows, columns), run_id)


def batches(pending: DataFrame, max_files: int) -> Iterator[list[tuple[str, int]]]:
    """(path, length) lists of at most `max_files`, by name; only one list is held at a time."""
    pending = materialize(pending.select("source_file", "path", "length"), "pending")
    last = None
    while True:
        rest = pending if last is None else pending.where(F.col("source_file") > last)
        batch = rest.orderBy("source_file").limit(max_files).collect()
        if not batch:
            return
        yield [(row["path"], row["length"]) for row in batch]
        last = batch[-1]["source_file"]


def load_directory(
    spark: SparkSession,
    directory: str,
    lane: Lane,
    table: str,
    store: Store,
    run_ts: str,
    max_files: int = 10_000,
) -> DataFrame:
    """Load every file in `directory` not processed yet; returns the run's totals.

    Files that fail stay unmarked and are tried again by the next run. Only new files
    are read, whatever the size of what has been loaded before.
    """
    listing = sources.list_files(spark, directory, lane.pattern)
    prefix, used = _run_prefix(run_ts), []
    for number, batch in enumerate(batches(pending_files(spark, listing, store), max_files)):
        store.tidy(spark)
        used += run_files(spark, batch, lane, table, store, f"{prefix}-{number}", run_ts)
    report_hidden(spark, directory, lane, store, f"{prefix}-hidden")
    return status.run_summary(store.status(spark, used))


def pending_files(spark: SparkSession, listing: DataFrame, store: Store) -> DataFrame:
    """The listed files that are not processed; of the ledger their buckets are read."""
    store.tidy(spark)
    listing = materialize(listing, "listing")
    done = ledger.at_stage(store.ledger(spark, listing.select("source_file")), PROCESSED)
    return ledger.unseen(listing, done)


def _run_prefix(run_ts: str) -> str:
    """Readable and unique: a second run within the same second must not replace the first."""
    return "run" + "".join(c for c in run_ts if c.isdigit()) + "-" + uuid.uuid4().hex[:8]


# --- landing -> raw zone -------------------------------------------------------------


def ingest_directory(
    spark: SparkSession,
    directory: str,
    lane: Lane,
    raw: str,
    store: Store,
    run_ts: str,
    max_files: int = 10_000,
) -> DataFrame:
    """Copy new landing files to the raw zone; returns one status row per file seen.

    The raw zone is Parquet by ingest run, rows tagged with their file. Its ledger row is
    what makes a file visible to the transform, so a run that stops half way leaves
    nothing behind that counts. JSON files must be strict arrays to count; their elements
    are kept as VARIANT beside the text, and a load reads these alone.
    """
    require_settings(spark)
    listing = materialize(sources.list_files(spark, directory, lane.pattern), "listing")
    known = ledger.at_stage(store.ledger(spark, listing.select("source_file")), INGESTED)
    # Written down before this run adds to the ledger: who was known at its start.
    skipped = materialize(ledger.seen(listing.select("source_file"), known), "skipped")
    prefix = _run_prefix(run_ts)
    outcomes = scratch_dir(spark, "outcomes")
    skipped.select("source_file", F.lit("skipped").alias("status")).write.parquet(outcomes)

    def copy(batch: list[tuple[str, int]], run_id: str) -> None:
        names = _names(spark, batch)
        folder, good = f"{raw}/run_id={run_id}", names
        if lane.name == JSON.name:
            # The text as it came, and its array parsed: the one parse of a document there is.
            documents.parsed(lane.read(spark, batch)).write.mode("overwrite").parquet(folder)
            good = _readable(spark.read.schema(lane.raw_columns).parquet(folder), names)
        else:
            lane.read(spark, batch).write.mode("overwrite").parquet(folder)
        store.mark(good, INGESTED, run_ts, run_id)
        result = names.join(good.withColumn("status", F.lit("processed")), "source_file", "left")
        result.withColumn("status", F.coalesce("status", F.lit("failed"))).write.mode("append").parquet(outcomes)

    def fail(batch: list[tuple[str, int]], run_id: str) -> None:
        _names(spark, batch).withColumn("status", F.lit("failed")).write.mode("append").parquet(outcomes)

    for number, batch in enumerate(batches(ledger.unseen(listing, known), max_files)):
        store.tidy(spark)
        isolate(batch, f"{prefix}-{number}", copy, fail)
    report_hidden(spark, directory, lane, store, f"{prefix}-hidden")
    return spark.read.schema("source_file string, status string").parquet(outcomes)


def _readable(frame: DataFrame, names: DataFrame) -> DataFrame:
    """The files among `names` whose contents are strict arrays throughout."""
    checked = documents.validate(frame).groupBy("source_file").agg(F.bool_and("is_valid").alias("ok"))
    verdict = materialize(names.join(checked, "source_file", "left"), "verdict")
    return verdict.where(F.coalesce("ok", F.lit(False))).select("source_file")


def load_raw(
    spark: SparkSession, lane: Lane, raw: str, table: str, store: Store, run_ts: str
) -> DataFrame:
    """Load every ingested file not processed yet from the raw zone; returns the run's totals."""
    entries = store.ledger(spark)
    ingested, processed = ledger.at_stage(entries, INGESTED), ledger.at_stage(entries, PROCESSED)
    pending = materialize(ledger.unseen(ingested.select("source_file", "run_id"), processed), "backlog")
    prefix, used = _run_prefix(run_ts), []
    for number, runs in enumerate(packs(spark, pending, raw)):
        store.tidy(spark)
        own = pending.where(F.col("run_id").isin(runs))
        # The folders of these runs by name: runs loaded long ago are not listed.
        reader = spark.read.schema(lane.raw_columns + ", run_id string").option("basePath", raw)
        folders = reader.parquet(*[f"{raw}/run_id={run}" for run in runs])
        # A file that an earlier run refused counts as the run has it that took it in.
        frame = folders.join(own, ["source_file", "run_id"], "left_semi").drop("run_id")
        used.append(f"{prefix}-{number}")
        load_frame(frame, own.select("source_file").distinct(), lane, table, store, used[-1], run_ts)
    return status.run_summary(store.status(spark, used))


#: Raw bytes, and ingest runs, that one load takes at most; a run is never cut.
LOAD_BYTES, LOAD_RUNS = 64 << 30, 1_000


def packs(spark: SparkSession, pending: DataFrame, raw: str) -> Iterator[list[str]]:
    """Outstanding ingest runs in order, packed into loads; one pack of names is held at a time."""
    held, size = [], 0
    for row in pending.select("run_id").distinct().orderBy("run_id").toLocalIterator():
        more = paths.size_of(spark, f"{raw}/run_id={row['run_id']}")
        if held and (size + more > LOAD_BYTES or len(held) >= LOAD_RUNS):
            yield held
            held, size = [], 0
        held.append(row["run_id"])
        size += more
    if held:
        yield held


def seed_ledger(
    spark: SparkSession, store: Store, log_path: str, stage: str, with_ts: bool = False, plain_counts: bool = True
) -> None:
    """Take over a plain log of file names (`name`, or `name|timestamp`) as ledger rows."""
    lines = sources.read_lines(spark, log_path)
    if with_ts:
        known = ledger.timestamps_from_log(lines, plain_counts)
    else:
        known = ledger.names_from_log(lines).withColumn("ts", F.lit(UNKNOWN_TS))
    rows = known.select(F.lit(stage).alias("stage"), "source_file", strip("ts").alias("ts"), F.lit("log").alias("run_id"))
    store.entries.append(rows)
