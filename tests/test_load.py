"""Loads through real files: reruns, crashes, failures, skew and the stream."""

import json
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ledger
from tidemill.plans import load
from tidemill.plans.load import JSON, PROCESSED, STARTED, TEXT, Store, ingest_directory, load_directory, load_raw
from tidemill.sources import files, tables
from tidemill.spec import JSON_RECORD, TEXT_RECORD
from tidemill.streaming.incremental import load_new

T1, T2, T3 = ("2026-04-01 00:00:0%d" % n for n in (1, 2, 3))


def line(event_id, day="2026-04-01", attendance=1):
    return f"Event ID: {event_id} | Sport: Football | Event Date: {day} | Attendance: {attendance}"


class Lake:
    def __init__(self, spark, base, spec):
        self.spark, self.landing = spark, base / "landing"
        self.landing.mkdir()
        self.raw, self.archive = str(base / "raw"), base / "archive"
        self.checkpoint = str(base / "checkpoint")
        self.store = Store(str(base / "state"))
        tables.create_database(spark, "lake", str(base / "db"))
        self.table = f"lake.t_{uuid.uuid4().hex}"
        tables.create_gold_table(spark, self.table, spec, str(base / "gold"))

    def land(self, name, *lines):
        (self.landing / name).write_text("\n".join(lines) + "\n", encoding="utf-8")

    def rows(self, *columns):
        self.spark.catalog.refreshTable(self.table)
        picked = self.spark.table(self.table).select(*(columns or ("event_id",)))
        return sorted(tuple(r) if len(r) > 1 else r[0] for r in picked.collect())

    def load(self, ts, lane=TEXT, **options):
        return tuple(load_directory(self.spark, str(self.landing), lane, self.table, self.store, ts, **options).first())


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, tmp_path, TEXT_RECORD)


@pytest.fixture
def json_lake(spark, tmp_path):
    return Lake(spark, tmp_path, JSON_RECORD)


def test_rerun_adds_nothing_and_failed_files_are_tried_again(spark, lake):
    lake.land("a.txt", "##INGEST_METADATA## source_file=a.txt ingest_ts=2026-03-01 10:00:00", line("A1"), line("A1"))
    lake.land("b.txt", line("B1"), "junk line")
    lake.land("c.txt", "nothing here")
    lake.land("ignored.csv", line("X"))
    assert lake.load(T1, max_files=2) == (2, 1, 3)
    assert lake.rows("event_id", "source_file", "ingest_ts", "processing_ts", "event_date") == [
        ("A1", "a.txt", "2026-03-01 10:00:00", T1, "2026-04-01"),
        ("A1", "a.txt", "2026-03-01 10:00:00", T1, "2026-04-01"),
        ("B1", "b.txt", "unknown", T1, "2026-04-01"),
    ]
    assert lake.load(T2) == (0, 1, 0)
    lake.land("c.txt", line("C1"))  # repaired: it was never marked, so it is read again
    lake.land("a.txt", line("changed"))  # a known name is not
    assert lake.load(T3) == (1, 0, 1)
    assert lake.rows() == ["A1", "A1", "B1", "C1"]
    rejects = {tuple(r)[:3] for r in lake.store.rejects(spark).collect()}
    assert ("b.txt", "junk line", "no_marker") in rejects and ("c.txt", "nothing here", "no_marker") in rejects


@pytest.mark.parametrize("present", ["none", "some", "all"])
def test_crash_between_append_and_mark(spark, lake, present):
    lake.land("a.txt", line("A1"), line("A1"), line("A2", day="bad"), line("A3", day="2026-04-02"))
    lake.land("b.txt", line("B1"))
    found = [(str(lake.landing / "a.txt"), 1)]
    rows = TEXT.records(TEXT.prepare(TEXT.read(spark, found)))
    keep = {"none": F.lit(False), "some": F.col("event_id") != "A2", "all": F.lit(True)}[present]
    written = rows.where(keep).withColumns({"ingest_ts": F.lit("unknown"), "processing_ts": F.lit("before")})
    if present == "some":
        written = written.dropDuplicates(["event_id"])  # one of the two equal rows
    tables.append_rows(written, lake.table, TEXT_RECORD)
    lake.store.mark(spark.createDataFrame([("a.txt",)], "source_file string"), STARTED, T1, "crashed")
    assert lake.load(T2) == (2, 0, 5)
    assert lake.rows("event_id", "event_date") == [
        ("A1", "2026-04-01"), ("A1", "2026-04-01"), ("A2", "1900-01-01"), ("A3", "2026-04-02"), ("B1", "2026-04-01"),
    ]
    assert lake.load(T3) == (0, 0, 0)


def test_crash_while_marking(spark, lake, monkeypatch):
    lake.land("a.txt", line("A1"), line("A2"))
    mark = Store.mark

    def fail(self, names, stage, ts, run_id):
        if stage == PROCESSED:
            raise OSError("lost")
        mark(self, names, stage, ts, run_id)

    with monkeypatch.context() as patch:
        patch.setattr(Store, "mark", fail)
        with pytest.raises(OSError):
            lake.load(T1)
    assert lake.rows() == ["A1", "A2"]
    assert lake.load(T2) == (1, 0, 2)
    assert lake.rows() == ["A1", "A2"]


def test_stream_reads_new_files_once(spark, lake):
    def run():
        load_new(spark, str(lake.landing), TEXT, lake.table, lake.store, lake.checkpoint, T1, max_files=1).awaitTermination()

    lake.land("a.txt", line("A1"))
    lake.land("b.txt", "junk")
    lake.land("c.txt", line("C1"))
    run()
    assert lake.rows() == ["A1", "C1"]
    run()
    lake.land("a.txt", line("changed"))
    run()
    assert lake.rows() == ["A1", "C1"]
    lake.land("d.txt", line("D1"))
    run()
    assert lake.rows() == ["A1", "C1", "D1"]
    outcome = {r["source_file"]: r["status"] for r in lake.store.status(spark).collect()}
    assert outcome == {"a.txt": "processed", "b.txt": "failed", "c.txt": "processed", "d.txt": "processed"}


def test_stream_batch_repeated_after_a_crash(spark, lake, monkeypatch):
    lake.land("a.txt", line("A1"), line("A1"))
    mark = Store.mark

    def fail(self, names, stage, ts, run_id):
        if stage == PROCESSED:
            raise OSError("lost")
        mark(self, names, stage, ts, run_id)

    def run():
        load_new(spark, str(lake.landing), TEXT, lake.table, lake.store, lake.checkpoint, T1).awaitTermination()

    with monkeypatch.context() as patch:
        patch.setattr(Store, "mark", fail)
        with pytest.raises(Exception, match="lost"):
            run()
    assert lake.rows() == ["A1", "A1"]
    run()
    assert lake.rows() == ["A1", "A1"]
    assert ledger.at_stage(lake.store.ledger(spark), PROCESSED).count() == 1


def test_stream_archives_consumed_files(spark, lake):
    def run():
        load_new(
            spark, str(lake.landing), TEXT, lake.table, lake.store, lake.checkpoint, T1, archive=str(lake.archive)
        ).awaitTermination()

    lake.land("a.txt", line("A1"))
    run()
    lake.land("b.txt", line("B1"))
    run()
    lake.land("c.txt", line("C1"))
    run()
    assert lake.rows() == ["A1", "B1", "C1"]
    assert [p.name for p in lake.archive.rglob("a.txt")] == ["a.txt"]
    assert not (lake.landing / "a.txt").exists()


def test_two_runs_in_the_same_second(spark, lake):
    for name in ("a", "b"):
        lake.land(f"{name}.txt", line(name))
        ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T1)
    assert tuple(load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T2).first()) == (2, 0, 2)
    assert lake.rows() == ["a", "b"]


def test_json_lane_through_the_raw_zone(spark, json_lake):
    lake = json_lake
    good = [{"event_id": "E1", "metadata": {"broadcast": True}}, 5, {"event_id": "E2", "event_date": "2026-05-05"}]
    lake.land("a.json", json.dumps(good, indent=2))
    lake.land("b.json", '{"a": 1}')
    lake.land("c.json", "[5]")
    lake.land("d.json", "[{}] junk")

    def ingest(ts):
        rows = ingest_directory(spark, str(lake.landing), JSON, lake.raw, lake.store, ts).collect()
        return {r["source_file"]: r["status"] for r in rows}

    assert ingest(T1) == {"a.json": "processed", "b.json": "failed", "c.json": "processed", "d.json": "failed"}
    assert tuple(load_raw(spark, JSON, lake.raw, lake.table, lake.store, T2).first()) == (1, 1, 2)
    assert lake.rows("event_id", "meta_broadcast", "source_file", "ingest_ts", "event_date") == [
        ("E1", "true", "a.json", T1, "1900-01-01"),
        ("E2", "false", "a.json", T1, "2026-05-05"),
    ]
    lake.land("b.json", '[{"event_id": "B"}]')
    assert ingest(T2) == {"a.json": "skipped", "b.json": "processed", "c.json": "skipped", "d.json": "failed"}
    assert tuple(load_raw(spark, JSON, lake.raw, lake.table, lake.store, T3).first()) == (1, 1, 1)
    assert lake.rows() == ["B", "E1", "E2"]


def test_interrupted_ingest_leaves_nothing_that_counts(spark, lake, monkeypatch):
    lake.land("a.txt", line("A1"))
    with monkeypatch.context() as patch:
        patch.setattr(Store, "mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T1)
    assert load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T1).first()["total_records"] == 0
    ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T2)
    load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T3)
    assert lake.rows("event_id", "ingest_ts") == [("A1", T2)]


def test_json_files_too_large_for_one_value(spark, json_lake):
    lake = json_lake
    lake.land("small.json", '[{"event_id": "S"}]')
    lake.land("large.json", json.dumps([{"event_id": f"L{n}"} for n in range(50)], indent=2))
    lake.land("broken.json", json.dumps([{"event_id": f"X{n}"} for n in range(50)])[:-1])
    lane = replace(
        JSON,
        read=lambda session, found: files.read_documents(session, found, whole_limit=100),
        costly=lambda found: True,
    )
    assert lake.load(T1, lane=lane) == (2, 1, 51)
    assert len(lake.rows()) == 51


def test_one_day_with_most_rows_is_written_by_many_tasks(spark, lake, tmp_path):
    rows = spark.range(200_000).select(
        *[F.col("id").cast("string").alias(c) for c in TEXT_RECORD.columns if c not in ("attendance", "event_date")],
        F.col("id").alias("attendance"),
        F.when(F.col("id") % 10 < 8, "1900-01-01").otherwise(F.concat(F.lit("2026-01-0"), F.col("id") % 9 + 1)).alias("event_date"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert tables.append_rows(rows, lake.table, TEXT_RECORD) == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    gold = tmp_path / "gold"
    hot = len(list((gold / "event_date=1900-01-01").glob("*.parquet")))
    cold = [len(list(d.glob("*.parquet"))) for d in gold.iterdir() if d.name.startswith("event_date=2026")]
    assert hot >= 4 and min(cold) == 1
    assert spark.table(lake.table).count() == 200_000


def test_columns_are_matched_by_name(spark, lake):
    row = {c: c for c in TEXT_RECORD.columns} | {"attendance": 7, "event_date": "2026-01-01"}
    shuffled = sorted(row, reverse=True)
    df = spark.createDataFrame([tuple(row[c] for c in shuffled)], shuffled)
    tables.append_rows(df, lake.table, TEXT_RECORD)
    assert spark.table(lake.table).first().asDict() == row


def test_table_upkeep(spark, lake):
    tables.create_gold_table(spark, lake.table, TEXT_RECORD, "ignored")  # exists already
    assert [f.name for f in spark.table(lake.table).schema] == TEXT_RECORD.columns
    described = {r["col_name"]: r["data_type"] for r in tables.describe(spark, lake.table).collect()}
    assert described["attendance"] == "bigint" and described["Type"] == "EXTERNAL"
    assert lake.table.split(".")[1] in {r["tableName"] for r in tables.tables(spark, "lake").collect()}
    assert [r["namespace"] for r in tables.databases(spark, "lake").collect()] == ["lake"]


def test_legacy_logs_become_the_ledger(spark, lake, tmp_path):
    (tmp_path / "names.log").write_text("a.txt\n\n  b.txt \na.txt\n")
    (tmp_path / "stamped.log").write_text("c.json|2026-01-01 00:00:00\nplain.json\nc.json|2026-01-02 00:00:00\n")
    load.seed_ledger(spark, lake.store, str(tmp_path / "names.log"), PROCESSED)
    load.seed_ledger(spark, lake.store, str(tmp_path / "stamped.log"), load.INGESTED, with_ts=True)
    rows = {(r["stage"], r["source_file"], r["ts"]) for r in lake.store.ledger(spark).collect()}
    assert rows == {
        (PROCESSED, "a.txt", "unknown"), (PROCESSED, "b.txt", "unknown"),
        (load.INGESTED, "c.json", "2026-01-02 00:00:00"), (load.INGESTED, "plain.json", "unknown"),
    }
    lake.land("a.txt", line("A1"))
    lake.land("z.txt", line("Z1"))
    assert lake.load(T1) == (1, 0, 1)
    assert lake.rows() == ["Z1"]


def test_missing_directory_is_an_error(spark, lake):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_directory(spark, str(lake.landing) + "-none", TEXT, lake.table, lake.store, T1)


def test_odd_file_names(spark, lake):
    for name in ("a [1].txt", "b{x,y}.txt", "c*.txt", "d%20e.txt", "f g.txt", "h+é.txt"):
        lake.land(name, line(name))
    assert lake.load(T1) == (6, 0, 6)
    assert lake.rows("event_id", "source_file") == [(n, n) for n in lake.rows()]
