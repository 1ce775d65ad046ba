"""Queries over the JSON lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import documents, ledger, reports, status
from tidemill.queries.landing import ORDERS_SQL, event_documents, events_sql, table
from tidemill.queries.text_lane import parsed_orders
from tidemill.spec import JSON_RECORD

_COLUMNS = ", ".join(JSON_RECORD.data_columns)
_PREVIEW = (
    "event_id", "event_name", "sport_type", "venue", "event_date",
    "status", "attendance", "meta_priority", "meta_broadcast", "meta_category",
)
_HIGH = (
    "event_id", "event_name", "venue", "event_date", "team_a", "team_b",
    "meta_priority", "meta_referee", "meta_notes",
)


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One chunk per file here, so an invalid file simply has no records.
    return documents.records(event_documents(spark, sf_dir))


def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.validate(event_documents(spark, sf_dir)).select("source_file", "is_valid")


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(spark, sf_dir).select("source_file", *JSON_RECORD.data_columns)


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.rejects(event_documents(spark, sf_dir))


def json_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.file_status(documents.block_summary(event_documents(spark, sf_dir)))


JSON_STATUS_SQL = f"""
WITH {events_sql()}, counted AS (
  SELECT source_file, any_value(file_rule) IN (1, 2, 3) AS broken,
    count(*) FILTER (rule <> 22) AS n_valid, count(*) FILTER (rule = 22) AS n_reject,
    count(*) FILTER (rule IN (15, 17, 18)) AS n_cast_failures
  FROM elements GROUP BY source_file
)
SELECT source_file, CASE WHEN broken THEN 0 ELSE n_valid END AS n_valid,
  CASE WHEN broken THEN 0 ELSE n_reject END AS n_reject,
  CASE WHEN broken THEN 0 ELSE n_cast_failures END AS n_cast_failures,
  CASE WHEN broken OR n_valid = 0 THEN 'failed' ELSE 'processed' END AS status
FROM counted"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest outcome of the event files where the ones named after suppliers are known."""
    known = table(spark, sf_dir, "supplier").select(
        F.format_string("events_%08d.json", "s_suppkey").alias("source_file")
    )
    files = documents.validate(event_documents(spark, sf_dir)).select("source_file", "is_valid")
    skipped = ledger.seen(files, known).select("source_file", F.lit("skipped").alias("status"))
    fresh = ledger.unseen(files, known).select(
        "source_file", F.when(F.col("is_valid"), "processed").otherwise("failed").alias("status")
    )
    return status.ingest_summary(skipped.unionByName(fresh))


INGEST_SQL = f"""
WITH {events_sql()}, files AS (SELECT DISTINCT source_file, file_rule FROM elements),
known AS (SELECT 'events_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '.json' AS source_file FROM supplier),
outcome AS (
  SELECT CASE WHEN source_file IN (SELECT source_file FROM known) THEN 'skipped'
    WHEN file_rule IN (1, 2, 3) THEN 'failed' ELSE 'processed' END AS status FROM files
)
SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed FROM outcome"""


def high_priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("event_date", "event_id", "source_file")
    high = F.col("meta_priority") == "High"
    return reports.listing(parsed_events(spark, sf_dir), _HIGH, high, order, limit=20)


def json_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(parsed_events(spark, sf_dir), _PREVIEW, order=("event_id", "source_file"), limit=10)


def compare_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compare_counts(
        {"Text Pipeline": parsed_orders(spark, sf_dir), "JSON Pipeline": parsed_events(spark, sf_dir)}
    )


def _fields(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsed_events(spark, sf_dir).select("source_file", "event_id", *names)

    columns = ", ".join(names)
    return query, _with(f"SELECT source_file, event_id, {columns} FROM parsed")


def _counts(key: str, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.count_by(parsed_events(spark, sf_dir), key, name=name)

    return query, _with(f"SELECT {key}, count(*) AS {name} FROM parsed GROUP BY {key} ORDER BY {name} DESC")


def _with(sql: str) -> str:
    return f"WITH {events_sql()}\n{sql}"


QUERIES = {
    "json_validate": (
        json_validate,
        _with("SELECT DISTINCT source_file, file_rule NOT IN (1, 2, 3) AS is_valid FROM elements"),
    ),
    "json_explode_typed": (json_parse, _with(f"SELECT source_file, {_COLUMNS} FROM parsed")),
    "json_rejects": (
        json_rejects,
        _with(
            "SELECT source_file, CAST(event_id AS VARCHAR) AS preview, 'not_an_object' AS reason "
            "FROM elements WHERE rule = 22 AND file_rule NOT IN (1, 2, 3)"
        ),
    ),
    "json_missing_vs_null": _fields("venue"),
    "json_lenient_bigint": _fields("attendance"),
    "json_strict_bool": _fields("meta_broadcast"),
    "json_date_guard": _fields("event_date"),
    "json_nested_fallback": _fields("meta_source_system", "meta_priority", "meta_referee", "meta_notes"),
    "json_file_status": (json_file_status, JSON_STATUS_SQL),
    "ingest_summary": (ingest_summary, INGEST_SQL),
    "count_all_json": (
        lambda spark, sf: reports.count_all(parsed_events(spark, sf)),
        _with("SELECT count(*) AS total_events FROM parsed"),
    ),
    "count_by_priority": _counts("meta_priority", "total"),
    "count_by_broadcast": _counts("meta_broadcast", "total"),
    "attendance_by_category": (
        lambda spark, sf: reports.total_by(
            parsed_events(spark, sf), "meta_category", "attendance", name="total", by="total"
        ),
        _with(
            "SELECT meta_category, count(*) AS total, CAST(sum(attendance) AS BIGINT) AS total_attendance "
            "FROM parsed GROUP BY meta_category ORDER BY total DESC"
        ),
    ),
    "count_by_source_system": _counts("meta_source_system", "events"),
    "count_by_referee": _counts("meta_referee", "assigned_events"),
    "compare_lanes": (
        compare_lanes,
        f"""SELECT 'Text Pipeline' AS pipeline, count(*) AS records FROM (WITH {ORDERS_SQL} SELECT * FROM parsed)
        UNION ALL
        SELECT 'JSON Pipeline', count(*) FROM (WITH {events_sql()} SELECT * FROM parsed)""",
    ),
    "high_priority_topk": (
        high_priority_topk,
        _with(
            f"SELECT {', '.join(_HIGH)} FROM parsed WHERE meta_priority = 'High' "
            "ORDER BY event_date, event_id, source_file LIMIT 20"
        ),
    ),
    "preview_json": (
        json_preview,
        _with(f"SELECT {', '.join(_PREVIEW)} FROM parsed ORDER BY event_id, source_file LIMIT 10"),
    ),
}
