"""Reports on a dated table, as functions and as the plain SQL people type."""

import uuid

import pytest
import synth
from pyspark.sql import functions as F

from tidemill.operators import reports
from tidemill.sources import tables
from tidemill.spec import JSON_RECORD, TEXT_RECORD

DAY = "2026-03-24"


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    """Both dated tables filled with synthetic events, a few of them with a junk day."""
    base = tmp_path_factory.mktemp("gold")
    tables.create_database(spark, "reports_db", str(base / "db"))
    rows = synth.rows(spark.range(2000), "id", F.to_date(F.lit(DAY))).withColumns(
        {
            "source_file": F.concat(F.lit("f"), (F.col("id") % 7).cast("string")),
            "ingest_ts": F.lit("i"),
            "processing_ts": F.lit("p"),
            "event_date": F.when(F.col("id") % 100 == 0, "abcdefghij").otherwise(F.col("event_date")),
        }
    )
    names = {}
    for lane, spec in {"text": TEXT_RECORD, "json": JSON_RECORD}.items():
        names[lane] = f"reports_db.{lane}_{uuid.uuid4().hex}"
        tables.create_gold_table(spark, names[lane], spec, str(base / lane))
        tables.append_rows(rows, names[lane], spec)
    return names


def same(left, right):
    return sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))


def test_grouped_reports_equal_sql(spark, gold):
    text, js = spark.table(gold["text"]), spark.table(gold["json"])
    sql = spark.sql
    pairs = [
        (reports.count_all(text), f"SELECT count(*) FROM {gold['text']}"),
        (reports.count_by(text, "sport_type"), f"SELECT sport_type, count(*) FROM {gold['text']} GROUP BY sport_type"),
        (reports.count_by(text, "venue", "city"), f"SELECT venue, city, count(*) FROM {gold['text']} GROUP BY 1, 2"),
        (reports.total_by(text, "city", "attendance"), f"SELECT city, sum(attendance), count(*) FROM {gold['text']} GROUP BY 1"),
        (reports.count_by(js, "meta_referee"), f"SELECT meta_referee, count(*) FROM {gold['json']} GROUP BY 1"),
        (
            reports.lineage(text),
            f"SELECT source_file, ingest_ts, count(*), min(event_date), max(event_date) FROM {gold['text']} GROUP BY 1, 2",
        ),
        (
            reports.compare_counts({"Text Pipeline": text, "JSON Pipeline": js}),
            f"SELECT 'Text Pipeline', count(*) FROM {gold['text']} UNION ALL SELECT 'JSON Pipeline', count(*) FROM {gold['json']}",
        ),
    ]
    for frame, query in pairs:
        assert same(frame, sql(query))


def test_counts_come_most_frequent_first(spark, gold):
    totals = [r["total"] for r in reports.count_by(spark.table(gold["text"]), "sport_type").collect()]
    assert totals == sorted(totals, reverse=True) and len(totals) == 6


def test_upcoming_equals_plain_sql_with_junk_days(spark, gold):
    rows = spark.table(gold["text"])
    football = F.col("sport_type") == "Football"
    found = reports.upcoming(rows, F.to_date(F.lit(DAY)), ["event_date", "event_id"], football, limit=5000)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    plain = spark.sql(
        f"SELECT event_date, event_id FROM {gold['text']} WHERE sport_type = 'Football' "
        f"AND event_date >= DATE '{DAY}' ORDER BY event_date"
    )
    assert same(found, plain) and found.count() > 500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_filter_prunes_partitions_and_columns(spark, gold):
    found = reports.upcoming(spark.table(gold["text"]), F.to_date(F.lit("2026-05-01")), ["event_date", "venue"])
    text = plan(found)
    assert "TakeOrderedAndProject" in text
    pruning = next(part for part in text.split("\n") if "PartitionFilters" in part)
    assert "event_date" in pruning.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    schema = pruning.split("ReadSchema: ")[1]
    assert "venue" in schema and "team_a" not in schema and "attendance" not in schema


def test_count_reads_no_columns_and_combines_before_the_shuffle(spark, gold):
    assert "ReadSchema: struct<>" in plan(reports.count_all(spark.table(gold["text"])))
    text = plan(reports.count_by(spark.table(gold["text"]), "status"))
    assert text.count("HashAggregate") == 2 and "ReadSchema: struct<status:string>" in text


def test_sum_survives_a_hot_key(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("city"),
        F.lit(1).cast("bigint").alias("attendance"),
    )
    first = reports.total_by(rows, "city", "attendance").first()
    assert tuple(first) == ("hot", 33334, 33334)


def test_synthetic_rows(spark):
    rows = synth.rows(spark.range(20_000), "id", F.to_date(F.lit(DAY)))
    row = rows.agg(
        F.min("attendance").alias("low"),
        F.max("attendance").alias("high"),
        F.min("event_date").alias("first"),
        F.max("event_date").alias("last"),
        F.count_if(F.col("team_a") == F.col("team_b")).alias("same"),
        F.count_if(F.col("city").isNull()).alias("nowhere"),
        F.count_if(F.col("sport_type") == "Football").alias("football"),
        F.countDistinct("event_name").alias("names"),
        F.countDistinct("team_b").alias("teams"),
    ).first()
    assert (row["first"], row["last"]) == ("2026-03-19", "2026-05-08")
    assert 5000 <= row["low"] < 5100 and 87900 < row["high"] <= 88000
    assert (row["same"], row["nowhere"], row["names"], row["teams"]) == (0, 0, 28, 18)
    assert 9500 < row["football"] < 10500
    again = synth.rows(spark.range(20_000).repartition(3), "id", F.to_date(F.lit(DAY)))
    assert rows.exceptAll(again).isEmpty()
