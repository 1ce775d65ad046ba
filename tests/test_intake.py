"""No file is lost at intake, whatever its age, neighbours or fate; sums don't wrap."""

import json
import os
import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_load import T1, T2, Lake, line

from tidemill.operators import documents, reports
from tidemill.plans.load import TEXT, ingest_directory, load_files, load_raw
from tidemill.sources import files, landing
from tidemill.sources.tables import missing_rows
from tidemill.spec import TEXT_RECORD
from tidemill.streaming.incremental import load_new


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, tmp_path, TEXT_RECORD)


def stream(lake, spark, ts=T1):
    load_new(spark, str(lake.landing), TEXT, lake.table, lake.store, lake.checkpoint, ts).awaitTermination()


def test_late_files_load(spark, lake):
    lake.land("new.txt", line("N"))
    stream(lake, spark)
    for days in (1, 10, 400):
        lake.land(f"old{days}.txt", line(f"O{days}"))
        then = time.time() - days * 86_400
        os.utime(lake.landing / f"old{days}.txt", (then, then))
    stream(lake, spark, T2)
    assert lake.rows() == ["N", "O1", "O10", "O400"]


def test_repaired_files_load(spark, lake):
    lake.land("a.txt", line("A"))
    lake.land("half.txt", "Event")
    stream(lake, spark)
    assert lake.rows() == ["A"]
    lake.land("half.txt", line("H"))
    stream(lake, spark, T2)
    assert lake.rows() == ["A", "H"]


def test_folders_hide_nothing(spark, lake):
    lake.land("a.txt", line("A"))
    for folder in ("k=1", "plain", "x.txt"):
        (lake.landing / folder).mkdir()
        lake.land(f"{folder}/inner.txt", line("INNER"))
    assert [r.source_file for r in files.list_files(spark, str(lake.landing), "*.txt").collect()] == ["a.txt"]
    assert lake.load(T1) == (1, 0, 1)
    stream(lake, spark, T2)
    assert lake.rows() == ["A"]


def test_underscored_names_are_files_like_others(spark, lake):
    lake.land("a.txt", line("A"))
    lake.land("_b.txt", line("B1"), line("B2"))
    lake.land(".c.txt", line("C"))  # as in a shell, a star is no leading dot
    listed = {(r.source_file, r.length) for r in files.list_files(spark, str(lake.landing), "*.txt").collect()}
    assert listed == {(n, (lake.landing / n).stat().st_size) for n in ("a.txt", "_b.txt")}
    assert lake.load(T1) == (2, 0, 3)
    lake.land("_d.txt", "##INGEST_METADATA## source_file=_d.txt ingest_ts=2026-03-01 10:00:00", line("D"))
    lake.land("_e e%20.txt", line("E"))
    stream(lake, spark, T2)
    stream(lake, spark, T2)
    assert lake.rows("event_id", "source_file", "ingest_ts") == [
        ("A", "a.txt", "unknown"), ("B1", "_b.txt", "unknown"), ("B2", "_b.txt", "unknown"),
        ("D", "_d.txt", "2026-03-01 10:00:00"), ("E", "_e e%20.txt", "unknown"),
    ]
    assert lake.load("2026-04-01 00:00:03") == (0, 0, 0)
    dotted = replace(TEXT, pattern=".*.txt")
    assert lake.load(T2, lane=dotted) == (1, 0, 1)


def test_underscored_names_through_the_raw_zone(spark, lake, tmp_path):
    lake.land("_b.txt", line("B"))
    lake.land("c.txt", line("C"))
    outcome = ingest_directory(spark, str(lake.landing), TEXT, lake.raw, lake.store, T1)
    assert {tuple(r) for r in outcome.collect()} == {("_b.txt", "processed"), ("c.txt", "processed")}
    load_raw(spark, TEXT, lake.raw, lake.table, lake.store, T2)
    assert lake.rows("event_id", "ingest_ts") == [("B", T1), ("C", T1)]


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_underscored_json_files(spark, tmp_path, limit):
    rows = [{"event_id": f"E{i}", "event_date": "2026-04-01"} for i in range(40)]
    for name in ("_a.json", "b.json"):
        (tmp_path / name).write_text(json.dumps(rows, indent=1))
    found = [(f"file:{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in ("_a.json", "b.json")]
    frame = files.read_documents(spark, found, whole_limit=limit)
    got = documents.records(frame).groupBy("source_file").agg(F.collect_set("event_id").alias("ids")).collect()
    assert {r.source_file: len(r.ids) for r in got} == {"_a.json": 40, "b.json": 40}


@pytest.mark.parametrize("kind", ["line", "brace"])
def test_pieces_do_not_depend_on_splits(kind, monkeypatch):
    rng = random.Random(8)
    ends = landing._ENDS[kind]
    for _ in range(300):
        text = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"}", b"\xef\xbb\xbf", b"\xff"]) for _ in range(rng.randint(0, 25)))
        monkeypatch.setattr(landing, "READ_BYTES", rng.randint(1, 9))
        step = rng.randint(1, 12)
        cuts = [(a, min(a + step, len(text))) for a in range(0, len(text), step)]

        def read(at, n, text=text):
            return text[at : at + n]

        found = [p for a, b in cuts for p in landing.pieces(read, len(text), a, b, ends)]
        plain = text.removeprefix(b"\xef\xbb\xbf")
        expected = re.split(ends, plain)
        assert found == (expected if expected[-1] else expected[:-1]), (text, step)


def test_pieces_are_what_sparks_text_source_reads(spark, tmp_path):
    text = "\ufefffirst\r\nsecond\rthird\n\nlast é".encode() + b"\xff\n"
    (tmp_path / "x.txt").write_bytes(text)
    (tmp_path / "_x.txt").write_bytes(text)
    found = [(f"file:{tmp_path}/{n}", len(text)) for n in ("x.txt", "_x.txt")]
    lines = files.read_listed(spark, found).select("source_file", "line_no", F.hex("value").alias("v")).orderBy("line_no").collect()
    assert [r.v for r in lines if r.source_file == "x.txt"] == [r.v for r in lines if r.source_file == "_x.txt"]


def test_a_vanished_file_fails_alone(spark, lake):
    lake.land("a.txt", line("A"))
    lake.land("gone.txt", line("G"))
    found = [(r.path, r.length) for r in files.list_files(spark, str(lake.landing), "*.txt").collect()]
    (lake.landing / "gone.txt").unlink()
    outcome = load_files(spark, found, TEXT, lake.table, lake.store, "r1", T1)
    assert {(r.source_file, r.status) for r in outcome.collect()} == {("a.txt", "processed"), ("gone.txt", "failed")}
    assert lake.rows() == ["A"]


def test_recheck_prunes_partitions(spark, lake):
    lake.land("a.txt", *(line(f"E{d}", f"2026-04-{d:02d}") for d in range(1, 11)))
    lake.load(T1)
    held = spark.table(lake.table)
    rows = spark.createDataFrame(held.where("event_date IN ('2026-04-03', '2026-04-05')").collect(), held.schema)
    plan = missing_rows(rows, lake.table, TEXT_RECORD)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ IN \(2026-04-0", plan)
    assert missing_rows(rows, lake.table, TEXT_RECORD).isEmpty()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sums_do_not_wrap(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    top = 2**63 - 1
    rows = spark.createDataFrame([("x", top), ("x", 5), ("y", top), ("y", 5), ("y", -5), ("z", 1)], "city string, attendance long")
    found = {r.city: r.total_attendance for r in reports.total_by(rows, "city", "attendance").collect()}
    assert found == {"x": None, "y": top, "z": 1}
    assert rows.agg(F.count("*")).first()[0] == 6
