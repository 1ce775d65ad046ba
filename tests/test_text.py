"""Rules of the labelled-text lane, one literal per case."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import WHITESPACE, has_only_spaces, lenient_bigint, on_or_after, partition_day, strip
from tidemill.operators import labeled, status

LINES = "source_file string, block bigint, line_no bigint, value string"


def frame(spark, *values, file="f.txt"):
    return spark.createDataFrame([(file, 0, n, v) for n, v in enumerate(values)], LINES)


def parse(spark, line):
    return labeled.records(labeled.classify(frame(spark, line))).first()


@pytest.mark.parametrize(
    "line, kind",
    [
        ("", "blank"),
        (" \t　", "blank"),
        ("##INGEST_METADATA## source_file=a ingest_ts=b", "header"),
        ("  ##INGEST_METADATA##", "header"),
        ("hello", "reject"),
        ("Event ID:E1", "reject"),
        ("Event ID: | Sport: X", "reject"),
        ("Sport: X | My Event ID: 1", "reject"),
        ("Event ID : E1 | Sport: X", "reject"),
        ("x | | Event ID: 5", "reject"),
        ("Event ID:  | Sport: X", "record"),
        ("Event ID: E1", "record"),
        ("\tEvent ID: E1 | Sport: X ", "record"),
        ("Sport: X |  Event ID\t: E1 | Note: Event ID: 2", "record"),
    ],
)
def test_kinds(spark, line, kind):
    assert labeled.classify(frame(spark, line)).first()["kind"] == kind


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Event ID:  | Sport: X", {"event_id": "", "sport_type": "X"}),
        ("Event ID: E1 | Sport: A | Sport: B", {"sport_type": "B"}),
        ("Event ID: E1 | Venue: a: b", {"venue": "a: b"}),
        ("Event ID: E1|Sport: X", {"event_id": "E1|Sport: X", "sport_type": ""}),
        ("Event ID: E1", {"venue": "", "attendance": 0, "event_date": "1900-01-01"}),
        ("Event ID: E1 | Attendance: 1,234", {"attendance": 1234}),
        ("Event ID: E1 | Attendance: 42.5", {"attendance": 0}),
        ("Event ID: E1 | Attendance: n/a", {"attendance": 0}),
        ("Event ID: E1 | Event Date: 2026-3-1", {"event_date": "1900-01-01"}),
        ("Event ID: E1 | Event Date: abcdefghij", {"event_date": "abcdefghij"}),
        ("Event ID: E1 | Event Date: 2026-13-45", {"event_date": "2026-13-45"}),
        ("Event ID: E1 | Event Date: éééééééééé",
         {"event_date": "é" * 10}),
        ("Event ID: E1 | City:\t  Doha 　| Team A: x", {"city": ""}),
        ("Event ID: E1 | City:  Doha　 | Team A: x", {"city": "Doha", "team_a": "x"}),
        ("Event ID: E1 |  City\t: Doha", {"city": "Doha"}),
    ],
)
def test_fields(spark, line, expected):
    row = parse(spark, line).asDict()
    assert {k: row[k] for k in expected} == expected


@pytest.mark.parametrize(
    "text, number",
    [
        ("42", 42), (" 42\t", 42), ("+42", 42), ("-42", -42), ("1,234,567", 1234567), (",,", 0), ("1_000", 1000),
        ("1__000", 0), ("_1", 0), ("1_", 0), ("42.0", 0), ("4 2", 0), ("", 0), (None, 0), ("0x1", 0), ("1e3", 0),
        ("9223372036854775807", 9223372036854775807), ("9223372036854775808", 0), ("007", 7),
    ],
)
def test_lenient_bigint(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(lenient_bigint(F.col("t"))).first()[0] == number


def test_strip_takes_every_kind_of_whitespace(spark):
    texts = [c + "a b" + c for c in WHITESPACE] + ["​a​", "", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", strip(F.col("t")).alias("s"), has_only_spaces(F.col("t")).alias("p")).collect()
    assert all(r["s"] == r["t"].strip() for r in got)
    assert all(r["t"].strip(" ") == r["t"].strip() for r in got if r["p"])


def test_partition_day_and_day_filter(spark):
    rows = spark.createDataFrame([("2026-03-01",), ("abcdefghij",), ("2026-13-45",), (None,), (" 2026-02-01 ",)], "d string")
    day = partition_day(F.col("d"))
    assert [r[0] for r in rows.select(day).collect()] == [
        "2026-03-01", "abcdefghij", "2026-13-45", "1900-01-01", "2026-02-01",
    ]
    as_of = F.to_date(F.lit("2026-02-01"))
    assert rows.select(day.alias("d")).where(on_or_after(F.col("d"), as_of)).count() == 2


def test_rejects_have_reason_and_short_preview(spark):
    lines = frame(spark, "  " + "x" * 100, "Event ID: | Sport: X", "", "##INGEST_METADATA##", "Event ID: ok")
    rows = {tuple(r) for r in labeled.rejects(labeled.classify(lines)).collect()}
    assert rows == {("f.txt", "x" * 80, "no_marker"), ("f.txt", "Event ID: | Sport: X", "no_required_pair")}


def ingest_ts(spark, *values, blocks=None):
    numbers = blocks or [0] * len(values)
    lines = spark.createDataFrame([("f", b, n, v) for n, (b, v) in enumerate(zip(numbers, values))], LINES)
    classified = labeled.classify(lines)
    counted = labeled.block_summary(classified).select("source_file", "block", "header_ts")
    scanned = labeled.block_headers(lines)
    assert sorted(map(tuple, scanned.collect()), key=str) == sorted(map(tuple, counted.collect()), key=str)
    facts = status.block_facts(scanned)
    return {r["ingest_ts"] for r in status.attach_ingest_ts(labeled.records(classified), facts).collect()}


def test_header_timestamp(spark):
    record, head = "Event ID: E", "##INGEST_METADATA## "
    assert ingest_ts(spark, record) == {"unknown"}
    assert ingest_ts(spark, head + "ingest_ts= 2026-01-01 00:00:00 ", record) == {"2026-01-01 00:00:00"}
    assert ingest_ts(spark, head + "x=1", record, head + "ingest_ts=b", head + "ingest_ts=a", record) == {"b"}
    assert ingest_ts(spark, record, "  " + head + "ingest_ts=a ingest_ts=b") == {"a ingest_ts=b"}
    assert ingest_ts(spark, "note ingest_ts=z", record) == {"unknown"}
    assert ingest_ts(spark, "note " + head + "ingest_ts=z", record, None, "") == {"unknown"}
    assert ingest_ts(spark, "\u3000\t" + head + "\x85ingest_ts=\u2003w\u2003", record) == {"w"}
    # The first header by place in the file, not by block order of arrival.
    assert ingest_ts(spark, head + "ingest_ts=late", record, head + "ingest_ts=early", blocks=[9, 9, 0]) == {"early"}


def test_file_status(spark):
    lines = (
        frame(spark, "Event ID: 1 | Attendance: x", "junk", "Event ID: 2", file="good")
        .unionByName(frame(spark, "junk", "", file="bad"))
        .unionByName(frame(spark, "", file="blank"))
    )
    names = spark.createDataFrame([("good",), ("bad",), ("blank",), ("empty",)], "source_file string")
    result = status.file_status(labeled.block_summary(labeled.classify(lines)), names)
    rows = {r["source_file"]: tuple(r)[1:] for r in result.collect()}
    assert rows == {
        "good": (2, 1, 1, "processed"),
        "bad": (0, 1, 0, "failed"),
        "blank": (0, 0, 0, "failed"),
        "empty": (0, 0, 0, "failed"),
    }
    assert tuple(status.run_summary(result).first()) == (1, 3, 2)
