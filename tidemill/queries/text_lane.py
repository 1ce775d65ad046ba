"""Queries over the labelled-text lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import WHITESPACE, lenient_bigint, partition_day
from tidemill.operators import labeled, reports, status
from tidemill.queries.landing import LINES_PER_BLOCK, ORDERS_SQL, order_file, order_lines, table
from tidemill.session import materialize, spread
from tidemill.spec import HEADER_MARKER, TEXT_RECORD

AS_OF = "1998-06-01"
_COLUMNS = ", ".join(TEXT_RECORD.data_columns)
_BLANKS = "'" + WHITESPACE + "'"


def parsed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeled.records(labeled.classify(order_lines(spark, sf_dir)))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: text that holds no record at all."""
    documents = spread(table(spark, sf_dir, "documents"))
    return documents.select(
        F.format_string("doc_%08d.txt", "doc_id").alias("source_file"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def stamped_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, with a lineage header on the files of every year but the first."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 06:00:00"))
    headed = (
        table(spark, sf_dir, "orders")
        .where(F.year("o_orderdate") > 1995)
        .select(order_file().alias("source_file"), stamp.alias("stamp"))
        .distinct()
    )
    return labeled.with_header_lines(order_lines(spark, sf_dir), headed, F.col("stamp"))


def _document_lines_sql() -> str:
    return f"""
doc_lines AS (
  SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS source_file,
         trim(unnest(string_split(text, chr(10))), {_BLANKS}) AS body
  FROM documents
)"""


def labeled_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_orders(spark, sf_dir).select("source_file", *TEXT_RECORD.data_columns)


def labeled_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).unionByName(document_lines(spark, sf_dir))
    return labeled.rejects(labeled.classify(lines))


REJECTS_SQL = f"""
WITH {ORDERS_SQL}, {_document_lines_sql()},
refused AS (
  SELECT 'orders_' || strftime(o_orderdate, '%Y%m%d') || '.txt' AS source_file,
    CASE rule WHEN 9 THEN 'Order: ' || o_orderkey ELSE 'Event ID:' END || ' | Event Name: ' || c_name
      || ' | Sport: ' || c_mktsegment || ' | Venue: ' || n_name || ' | City: ' || r_name
      || ' | Country: Atlantis | Event Date: ' || strftime(o_orderdate, '%Y-%m-01') AS body
  FROM details WHERE rule IN (9, 10)
  UNION ALL SELECT source_file, body FROM doc_lines WHERE body <> ''
)
SELECT source_file, left(body, 80) AS preview,
  CASE WHEN contains(body, 'Event ID:') THEN 'no_required_pair' ELSE 'no_marker' END AS reason
FROM refused"""


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stamped_order_lines(spark, sf_dir).unionByName(document_lines(spark, sf_dir))
    return labeled.classify(lines).groupBy("kind").agg(F.count("*").alias("n"))


LINE_KINDS_SQL = f"""
WITH {ORDERS_SQL}, {_document_lines_sql()},
kinds AS (
  SELECT CASE WHEN rule IN (9, 10) THEN 'reject' ELSE 'record' END AS kind FROM details
  UNION ALL SELECT 'header' FROM (SELECT DISTINCT o_orderdate FROM orders WHERE year(o_orderdate) > 1995)
  UNION ALL SELECT CASE WHEN body = '' THEN 'blank' ELSE 'reject' END FROM doc_lines
)
SELECT kind, count(*) AS n FROM kinds GROUP BY kind"""


def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the status given twice: the later one counts."""
    text = F.concat(
        F.lit("Event ID: "),
        F.col("l_orderkey").cast("string"),
        F.lit(" | Status: "),
        "l_linestatus",
        F.lit(" | Attendance: "),
        F.col("l_partkey").cast("string"),
        F.lit(" |  Status : kept"),
        F.lit(" | Status: "),
        "l_returnflag",
        F.lit("|x | Attendance: "),
        F.col("l_suppkey").cast("string"),
    )
    lines = spread(table(spark, sf_dir, "lineitem")).select(
        F.lit("items.txt").alias("source_file"),
        F.floor(F.col("l_orderkey") / LINES_PER_BLOCK).alias("block"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        text.alias("value"),
    )
    return labeled.records(labeled.classify(lines)).select("event_id", "status", "attendance")


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number reading of prices written in many ways."""
    price, whole = F.col("l_extendedprice"), F.floor("l_extendedprice")
    raw = (
        F.when(F.col("l_linenumber") == 1, whole.cast("string"))
        .when(F.col("l_linenumber") == 2, F.format_string(" %,d\t", whole))
        .when(F.col("l_linenumber") == 3, F.format_string("%.2f", price))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("+"), whole.cast("string")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("-"), whole.cast("string")))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("1_"), whole.cast("string")))
        .otherwise(F.concat(F.lit("9876543210"), whole.cast("string"), F.lit("00000")))
    )
    items = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return items.withColumn("number", lenient_bigint(F.col("raw")))


LENIENT_SQL = r"""
WITH written AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN CAST(w AS VARCHAR) WHEN 2 THEN ' ' || format('{:,}', w) || chr(9)
    WHEN 3 THEN printf('%.2f', l_extendedprice) WHEN 4 THEN '+' || w WHEN 5 THEN '-' || w
    WHEN 6 THEN '1_' || w ELSE '9876543210' || w || '00000' END AS raw
  FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem)
), cleaned AS (SELECT *, trim(replace(raw, ',', ''), ' ' || chr(9)) AS c FROM written)
SELECT l_orderkey, l_linenumber, raw,
  CASE WHEN regexp_full_match(c, '[+-]?\d+(_\d+)*')
       THEN coalesce(TRY_CAST(ltrim(replace(c, '_', ''), '+') AS BIGINT), 0) ELSE 0 END AS number
FROM cleaned"""


def partition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in many ways; only a length of ten passes."""
    written = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "view", F.date_format("ts", " yyyy-MM-dd\t"))
        .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-M-d"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-'99'"))
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", partition_day(written).alias("event_date"))


PARTITION_GUARD_SQL = """
SELECT event_id, CASE event_type WHEN 'click' THEN d WHEN 'view' THEN d WHEN 'signup' THEN left(d, 8) || '99'
  WHEN 'error' THEN CASE WHEN length(short) = 10 THEN short ELSE '1900-01-01' END ELSE '1900-01-01' END AS event_date
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%-m-%-d') AS short FROM events)"""


def header_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a file per user and day; sign-ups are header lines in between.

    Errors are header lines without a timestamp, so the first header is not always the one.
    """
    value = (
        F.when(
            F.col("event_type") == "signup",
            F.concat(F.lit(HEADER_MARKER + " ingest_ts="), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        )
        .when(F.col("event_type") == "error", F.lit(HEADER_MARKER + " source_file=unknown"))
        .otherwise(F.concat(F.lit("Event ID: E"), F.col("event_id").cast("string")))
    )
    lines = spread(table(spark, sf_dir, "events")).select(
        F.concat_ws("_", F.lit("user"), "user_id", F.date_format("ts", "yyyyMMdd")).alias("source_file"),
        F.floor(F.col("event_id") / LINES_PER_BLOCK).alias("block"),
        F.col("event_id").alias("line_no"),
        value.alias("value"),
    )
    # Written down first, so that the join sees how small the facts are.
    facts = status.block_facts(materialize(labeled.block_headers(lines), "blocks"))
    rows = status.attach_ingest_ts(labeled.records(labeled.classify(lines)), facts)
    return rows.select("source_file", "event_id", "ingest_ts")


HEADER_SQL = """
WITH placed AS (
  SELECT *, 'user_' || user_id || '_' || strftime(ts, '%Y%m%d') AS source_file FROM events
), stamps AS (
  SELECT source_file, arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id) AS stamp
  FROM placed WHERE event_type = 'signup' GROUP BY source_file
)
SELECT source_file, 'E' || event_id AS event_id, coalesce(stamp, 'unknown') AS ingest_ts
FROM placed LEFT JOIN stamps USING (source_file) WHERE event_type NOT IN ('signup', 'error')"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).unionByName(document_lines(spark, sf_dir))
    return status.file_status(labeled.block_summary(labeled.classify(lines)))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.run_summary(_status(spark, sf_dir))


_STATUS_SQL = f"""
WITH {ORDERS_SQL}, {_document_lines_sql()},
counted AS (
  SELECT 'orders_' || strftime(o_orderdate, '%Y%m%d') || '.txt' AS source_file,
    count(*) FILTER (rule NOT IN (9, 10)) AS n_valid, count(*) FILTER (rule IN (9, 10)) AS n_reject,
    count(*) FILTER (rule IN (1, 2, 15)) AS n_cast_failures
  FROM details GROUP BY 1
  UNION ALL SELECT source_file, 0, count(*) FILTER (body <> ''), 0 FROM doc_lines GROUP BY 1
), outcome AS (SELECT *, CASE WHEN n_valid > 0 THEN 'processed' ELSE 'failed' END AS status FROM counted)"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stamped_order_lines(spark, sf_dir)
    # Written down first, so that the join sees how small the facts are.
    facts = status.block_facts(materialize(labeled.block_headers(lines), "blocks"))
    return reports.lineage(status.attach_ingest_ts(labeled.records(labeled.classify(lines)), facts))


LINEAGE_SQL = f"""
WITH {ORDERS_SQL}
SELECT source_file, ingest_ts, count(*) AS records, min(event_date) AS earliest_event, max(event_date) AS latest_event
FROM (
  SELECT p.source_file, p.event_date, CASE WHEN year(o_orderdate) > 1995
    THEN strftime(o_orderdate, '%Y-%m-%d') || ' 06:00:00' ELSE 'unknown' END AS ingest_ts
  FROM parsed p JOIN orders ON p.line_no = o_orderkey
) GROUP BY source_file, ingest_ts"""

_UPCOMING = ("event_date", "event_name", "venue", "team_a", "team_b", "status", "attendance")
_AT_VENUE = ("event_id", "event_name", "event_date", "team_a", "team_b", "status", "attendance")
_PREVIEW = ("event_id", "event_name", "sport_type", "venue", "event_date", "status", "attendance")
_FULL_ORDER = ("event_date", "event_id", "source_file", "attendance")


def upcoming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_date(F.lit(AS_OF))
    wanted = F.col("sport_type") == "MACHINERY"
    return reports.upcoming(parsed_orders(spark, sf_dir), as_of, _UPCOMING, wanted, _FULL_ORDER)


def venue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("venue") == "NATION_7"
    return reports.listing(parsed_orders(spark, sf_dir), _AT_VENUE, at, _FULL_ORDER)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("event_id", "event_date", "attendance", "source_file")
    return reports.listing(parsed_orders(spark, sf_dir), _PREVIEW, order=order, limit=10)


def _with(sql: str) -> str:
    return f"WITH {ORDERS_SQL}\n{sql}"


QUERIES = {
    "labeled_parse": (labeled_parse, _with(f"SELECT source_file, {_COLUMNS} FROM parsed")),
    "labeled_rejects": (labeled_rejects, REJECTS_SQL),
    "labeled_line_kinds": (line_kinds, LINE_KINDS_SQL),
    "labeled_duplicate_key": (
        duplicate_labels,
        "SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_returnflag || '|x' AS status, l_suppkey AS attendance FROM lineitem",
    ),
    "lenient_bigint": (lenient_numbers, LENIENT_SQL),
    "partition_key_guard": (partition_guard, PARTITION_GUARD_SQL),
    "header_attribute": (header_attribute, HEADER_SQL),
    "file_status": (
        file_status,
        _STATUS_SQL + " SELECT source_file, n_valid, n_reject, n_cast_failures, status FROM outcome",
    ),
    "run_summary": (
        run_summary,
        _STATUS_SQL
        + """ SELECT count(*) FILTER (status = 'processed') AS files_processed,
          count(*) FILTER (status = 'failed') AS files_failed, CAST(sum(n_valid) AS BIGINT) AS total_records
          FROM outcome""",
    ),
    "count_all": (
        lambda spark, sf: reports.count_all(parsed_orders(spark, sf)),
        _with("SELECT count(*) AS total_events FROM parsed"),
    ),
    "count_by_sport": (
        lambda spark, sf: reports.count_by(parsed_orders(spark, sf), "sport_type"),
        _with("SELECT sport_type, count(*) AS total FROM parsed GROUP BY sport_type ORDER BY total DESC"),
    ),
    "count_by_venue_city": (
        lambda spark, sf: reports.count_by(parsed_orders(spark, sf), "venue", "city", name="bookings"),
        _with("SELECT venue, city, count(*) AS bookings FROM parsed GROUP BY venue, city ORDER BY bookings DESC"),
    ),
    "count_by_status": (
        lambda spark, sf: reports.count_by(parsed_orders(spark, sf), "status", name="count"),
        _with('SELECT status, count(*) AS "count" FROM parsed GROUP BY status ORDER BY 2 DESC'),
    ),
    "attendance_by_city": (
        lambda spark, sf: reports.total_by(parsed_orders(spark, sf), "city", "attendance"),
        _with(
            "SELECT city, CAST(sum(attendance) AS BIGINT) AS total_attendance, count(*) AS events "
            "FROM parsed GROUP BY city ORDER BY 2 DESC"
        ),
    ),
    "lineage_min_max": (lineage, LINEAGE_SQL),
    "upcoming_topk": (
        upcoming_topk,
        _with(
            f"SELECT {', '.join(_UPCOMING)} FROM parsed WHERE sport_type = 'MACHINERY' "
            f"AND TRY_CAST(event_date AS DATE) >= DATE '{AS_OF}' ORDER BY {', '.join(_FULL_ORDER)} LIMIT 20"
        ),
    ),
    "venue_listing": (
        venue_listing,
        _with(f"SELECT {', '.join(_AT_VENUE)} FROM parsed WHERE venue = 'NATION_7'"),
    ),
    "preview": (
        preview,
        _with(
            f"SELECT {', '.join(_PREVIEW)} FROM parsed ORDER BY event_id, event_date, attendance, source_file LIMIT 10"
        ),
    ),
}
