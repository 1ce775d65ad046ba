"""State that does not age, files that cannot be read, and the archive."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_load import T1, T2, T3, Lake, line

from tidemill.operators import documents, ledger
from tidemill.plans import load
from tidemill.plans.load import INGESTED, JSON, PROCESSED, STARTED, TEXT, archive_processed, ingest_directory, isolate
from tidemill.sources import ledger_files, paths
from tidemill.sources.ledger_files import LedgerFiles
from tidemill.spec import JSON_RECORD, TEXT_RECORD
from tidemill.streaming.incremental import load_new


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, tmp_path, TEXT_RECORD)


def names(spark, *found):
    return spark.createDataFrame([(n,) for n in found], "source_file string")


def damage(lake, name):
    """Make a file that every reader of the file system refuses: its checksum is another file's."""
    (lake.landing / f".{name}.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x12\x34\x56\x78")


# --- ledger ---------------------------------------------------------------------------


def content(spark, files):
    return sorted(tuple(r) for r in files.read(spark).collect())


def test_merging_changes_nothing_but_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_files, "BUCKET_ROWS", 4)
    files = LedgerFiles(str(tmp_path / "ledger"))
    assert content(spark, files) == [] and not files.merge(spark, 0)
    rows = set()
    for run in range(7):
        found = [f"f{run}-{i}.txt" for i in range(5)]
        files.append(ledger.entries(names(spark, *found), STARTED if run % 2 else PROCESSED, T1, f"r{run}"))
        rows |= {(STARTED if run % 2 else PROCESSED, n, T1, f"r{run}") for n in found}
        assert files.merge(spark, 1) == (run % 2 == 1)
        assert content(spark, files) == sorted(rows)
    files.append(ledger.entries(names(spark, "f0-0.txt"), PROCESSED, T2, "later"))
    assert files.merge(spark, 0)
    # A small merge leaves a much larger run alone; the older row goes when that one is merged.
    later = {(PROCESSED, "f0-0.txt", T2, "later")}
    assert content(spark, files) == sorted(rows | later)
    files.append(ledger.entries(names(spark, *(f"g{i}" for i in range(30))), PROCESSED, T1, "r"))
    assert files.merge(spark, 0) and len(files.state(spark).runs) == 1
    rows = {r for r in rows if r[:2] != (PROCESSED, "f0-0.txt")} | {(PROCESSED, f"g{i}", T1, "r") for i in range(30)}
    assert content(spark, files) == sorted(rows | later)


def test_files_read_stay_few_after_a_thousand_runs(spark, lake):
    """1,000 past runs, each a delta of its own; then loads go on as they would."""
    folder = f"{lake.store.root}/ledger/deltas"
    for k in range(1000):
        os.makedirs(f"{folder}/d{k}")
        pq.write_table(pa.table({"stage": ["processed"], "source_file": [f"past{k}.txt"], "ts": [T1], "run_id": ["r"]}), f"{folder}/d{k}/part.parquet")
        open(f"{folder}/d{k}/_SUCCESS", "w").close()
    for run in range(3):
        lake.land(f"new{run}.txt", line(f"N{run}"))
        lake.land(f"past{run}.txt", line(f"P{run}"))
        assert lake.load(f"2026-04-01 00:00:1{run}") == (1, 0, 1)
        assert len(lake.store.ledger(spark).inputFiles()) <= ledger_files.MOST_DELTAS + 4
    assert lake.rows() == ["N0", "N1", "N2"]
    assert ledger.at_stage(lake.store.ledger(spark), PROCESSED).count() == 1003
    # The status of a load is read from its own runs' folders.
    for k in range(5):
        lake.store.put("status", spark.createDataFrame([("x", 1, 0, 0, "processed")], "source_file string, n_valid long, n_reject long, n_cast_failures long, status string"), f"old{k}")
    assert all("run_id=old3/" in f for f in lake.store.status(spark, ["old3"]).inputFiles())
    assert lake.load(T3) == (0, 0, 0)


def test_runs_stay_few_and_grow(spark, tmp_path):
    files, most = LedgerFiles(str(tmp_path / "ledger")), 0
    for run in range(24):
        files.append(ledger.entries(names(spark, *(f"f{run}-{i}" for i in range(3))), PROCESSED, T1, "r"))
        files.merge(spark, 1)
        most = max(most, len(files.state(spark).runs))
    assert most <= 4 and len(content(spark, files)) == 72
    on_disk = sum(len(found) for _, _, found in os.walk(tmp_path / "ledger" / "runs"))
    assert on_disk < 60  # what was merged away is deleted


def test_a_batch_opens_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_files, "BUCKET_ROWS", 8)
    files = LedgerFiles(str(tmp_path / "ledger"))
    every = [f"file{i}.txt" for i in range(500)]
    files.append(ledger.entries(names(spark, *every), PROCESSED, T1, "r"))
    assert files.merge(spark, 0) and files.state(spark).runs[0][2] == 64
    asked = names(spark, "file7.txt", "file8.txt", "other.txt")
    held = files.read(spark, asked)
    assert sorted(r.source_file for r in ledger.seen(asked, held).collect()) == ["file7.txt", "file8.txt"]
    assert [r.source_file for r in ledger.unseen(asked, held).collect()] == ["other.txt"]
    plan = held._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [bucket" in plan.toString()
    assert held.select(F.input_file_name().alias("f")).distinct().count() <= 3
    assert held.count() < 60 and files.read(spark).count() == 500


def test_a_merge_that_loses_the_race_leaves_the_state(spark, tmp_path, monkeypatch):
    files = LedgerFiles(str(tmp_path / "ledger"))
    files.append(ledger.entries(names(spark, "a"), PROCESSED, T1, "r"))
    monkeypatch.setattr(paths, "put_new", lambda *a: False)
    assert not files.merge(spark, 0)
    assert content(spark, files) == [(PROCESSED, "a", T1, "r")]
    assert paths.names_in(spark, f"{files.root}/runs") == []


# --- files that cannot be read ----------------------------------------------------------


@pytest.mark.parametrize("bad", [["m.txt"], ["b.txt", "m.txt", "y.txt"]])
def test_unreadable_files_fail_alone(spark, lake, bad):
    for c in "abcdefghijklmnopqrstuvwxyz":
        lake.land(f"{c}.txt", line(c.upper()))
    for name in bad:
        damage(lake, name)
    assert lake.load(T1) == (26 - len(bad), len(bad), 26 - len(bad))
    assert {r.source_file for r in lake.store.status(spark).where("status = 'failed'").collect()} == set(bad)
    for name in bad:
        os.remove(lake.landing / f".{name}.crc")
    assert lake.load(T2) == (len(bad), 0, len(bad))
    assert lake.rows() == list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_unreadable_files_fail_alone_in_stream_and_ingest(spark, lake):
    for name in ("a.txt", "b.txt", "c.txt"):
        lake.land(name, line(name[0].upper()))
    damage(lake, "b.txt")
    outcome = ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T1)
    assert {tuple(r) for r in outcome.collect()} == {("a.txt", "processed"), ("b.txt", "failed"), ("c.txt", "processed")}

    def stream(ts):
        load_new(spark, str(lake.landing), TEXT, lake.table, lake.store, lake.checkpoint, ts).awaitTermination()

    stream(T1)
    assert lake.rows() == ["A", "C"]
    os.remove(lake.landing / ".b.txt.crc")
    stream(T2)
    assert lake.rows() == ["A", "B", "C"]


@pytest.mark.parametrize("named", [True, False])
def test_isolation_takes_few_more_loads(named):
    found = [(f"file:/in/f{i}.txt", 1) for i in range(1000)]
    bad, loads, loaded, failed = {found[3], found[700]}, [], [], []

    def run(batch, own):
        loads.append(own)
        if hit := bad & set(batch):
            raise RuntimeError("FAILED_READ_FILE " + (f"Encountered error while reading file {min(hit)[0]}. SQLSTATE" if named else "?"))
        loaded.extend(batch)

    used = isolate(found, "r", run, lambda batch, own: failed.extend(batch))
    assert set(failed) == bad and sorted(loaded) == sorted(set(found) - bad) and len(set(used)) == len(used)
    assert len(loads) - 1 <= (2 if named else 2 * 2 * 10)
    with pytest.raises(RuntimeError, match="disk full"):
        isolate(found, "r", lambda *a: (_ for _ in ()).throw(RuntimeError("disk full")), None)


def test_names_in_messages():
    assert load._is_named("file:/in/a.txt", "reading file file:/in/a.txt. SQLSTATE: KD001")
    assert load._is_named("file:/in/a b.txt", "reading file file:/in/a%20b.txt.")
    assert not load._is_named("file:/in/a.txt", "reading file file:/in/a.txt.old. SQLSTATE")
    assert not load._is_named("file:/in/a", "reading file file:/in/ab.")


# --- archive ----------------------------------------------------------------------------


def test_archive_heals_after_a_crash(spark, lake, monkeypatch):
    for name in ("a.txt", "b.txt", "_c.txt"):
        lake.land(name, line(name.strip("_.tx").upper()))
    lake.land("bad.txt", "nothing")
    lake.load(T1)
    moved, move = [], paths.move_into

    def once(spark, path, folder):
        if moved:
            raise OSError("lost")
        moved.append(path)
        return move(spark, path, folder)

    with monkeypatch.context() as patch:
        patch.setattr(paths, "move_into", once)
        with pytest.raises(OSError, match="lost"):
            archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive))
    assert len(list(lake.archive.iterdir())) >= 1
    assert archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive)) == 2
    assert archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive)) == 0
    assert sorted(p.name for p in lake.archive.iterdir() if not p.name.endswith(".crc")) == ["_c.txt", "a.txt", "b.txt"]
    assert sorted(p.name for p in lake.landing.iterdir() if not p.name.endswith(".crc")) == ["bad.txt"]
    lake.land("a.txt", line("A"))  # a known name: not loaded again, moved over the old one
    assert lake.load(T2) == (0, 1, 0)
    assert archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive)) == 1


def test_archive_after_ingest(spark, lake):
    lake.land("a.txt", line("A"))
    ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T1)
    assert archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive)) == 0
    assert archive_processed(spark, str(lake.landing), TEXT, lake.store, str(lake.archive), stage=INGESTED) == 1


def test_raw_json_is_parsed_once(spark, tmp_path):
    """Ingest parses; what the load reads of the raw zone is neither text nor parsed again."""
    lake = Lake(spark, tmp_path, JSON_RECORD)
    texts = {"a.json": '[{"event_id": "A", "metadata": {"broadcast": true}}, 5]', "b.json": "[1", "c.json": '[{"event_id": "C", "attendance": "1e3"}]'}
    for name, text in texts.items():
        (lake.landing / name).write_text(text)
    outcome = ingest_directory(spark, str(lake.landing), JSON, lake.raw, lake.store, T1)
    assert {tuple(r) for r in outcome.collect()} == {("a.json", "processed"), ("b.json", "failed"), ("c.json", "processed")}
    assert tuple(load.load_raw(spark, JSON, lake.raw, lake.table, lake.store, T2).first()) == (2, 0, 2)
    assert lake.rows("event_id", "meta_broadcast", "attendance") == [("A", "true", 0), ("C", "false", 0)]
    raw = spark.read.schema(JSON.raw_columns).parquet(lake.raw)
    for frame in (JSON.summarize(raw), JSON.records(raw), JSON.rejects(raw)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "parsejson" not in plan.lower() and "value#" not in plan
    text = spark.read.parquet(lake.raw)
    assert {r.source_file: r.value for r in text.collect()} == texts
    assert documents.parsed(text.select("value"))._jdf.queryExecution().executedPlan().toString().lower().count("parsejson(") == 1


# --- raw runs ---------------------------------------------------------------------------


@pytest.mark.parametrize("limit, loads", [(1 << 30, 1), (1, 50)])
def test_outstanding_raw_runs_load_together(spark, lake, monkeypatch, limit, loads):
    """Fifty ingest runs that nobody has loaded, one of which has left a folder without a mark."""
    runs = spark.range(51).selectExpr(
        "format_string('run%02d', id) AS run_id", "format_string('f%d.txt', id) AS source_file",
        "0L AS block", "0L AS line_no", "concat('Event ID: E', id, ' | Event Date: 2026-04-01') AS value",
    )
    runs.write.partitionBy("run_id").parquet(lake.raw)
    marked = runs.where("run_id != 'run50'").select(F.lit(INGESTED).alias("stage"), "source_file", F.lit(T1).alias("ts"), "run_id")
    lake.store.entries.append(marked)
    monkeypatch.setattr(load, "LOAD_BYTES", limit)
    assert [len(p) for p in load.packs(spark, marked, lake.raw)] == [50 // loads] * loads
    if loads > 1:
        return
    calls, frame = [], load.load_frame
    monkeypatch.setattr(load, "load_frame", lambda *a: calls.append(a[5]) or frame(*a))
    assert tuple(load.load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T2).first()) == (50, 0, 50)
    assert len(calls) == 1 and len(lake.rows()) == 50
    assert set(lake.rows("ingest_ts", "processing_ts")) == {(T1, T2)}
    assert tuple(load.load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T3).first()) == (0, 0, 0)
