"""Queries over file ledgers and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import ledger, reports
from tidemill.queries.landing import LINES_PER_BLOCK, table


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.format_string("c%d.json", "c_custkey").alias("source_file"))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines `file|timestamp`, one per event; errors log the bare name, sign-ups a blank line first."""
    name = F.format_string("c%d.json", "user_id")
    stamped = F.concat(name, F.lit("|"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "))
    entry = (
        F.when(F.col("event_type") == "error", F.array(name))
        .when(F.col("event_type") == "signup", F.array(F.lit(" \t"), stamped))
        .otherwise(F.array(stamped))
    )
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / LINES_PER_BLOCK).alias("block"),
        F.col("event_id").alias("line_no"),
        F.explode(entry).alias("value"),
    )


def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of bare names, one per event, with blank lines and stray blanks."""
    name = F.format_string(" c%d.json\t", "user_id")
    line = F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(name)
    return table(spark, sf_dir, "events").select(line.alias("value"))


def ledger_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unseen(customer_files(spark, sf_dir), ledger.names_from_log(user_names(spark, sf_dir)))


def ledger_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seen(customer_files(spark, sf_dir), ledger.names_from_log(user_names(spark, sf_dir)))


def ledger_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers with orders (ingested) but without events (processed)."""
    ordered = table(spark, sf_dir, "orders").select(F.format_string("c%d.json", "o_custkey").alias("source_file"))
    return ledger.backlog(ordered, ledger.names_from_log(user_names(spark, sf_dir)))


def _lookup(plain_counts: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = ledger.timestamps_from_log(user_log(spark, sf_dir), plain_counts)
        return ledger.with_ts(customer_files(spark, sf_dir), known)

    # A bare line hides an earlier timestamp in the one reading and is passed over in the other.
    stamp = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    if plain_counts:
        last = f"SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'unknown' ELSE {stamp} END, event_id) AS t"
        last += " FROM events GROUP BY user_id"
    else:
        last = f"SELECT user_id, arg_max({stamp}, event_id) AS t FROM events WHERE event_type <> 'error' GROUP BY user_id"
    sql = f"""
WITH stamps AS ({last})
SELECT 'c' || c_custkey || '.json' AS source_file, coalesce(t, 'unknown') AS ingest_ts
FROM customer LEFT JOIN stamps ON c_custkey = user_id"""
    return query, sql


_USERS = "SELECT 'c' || user_id || '.json' FROM events WHERE event_type <> 'view'"
_FILES = "SELECT 'c' || c_custkey || '.json' AS source_file FROM customer"


def customers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and its region, both looked up in the dimension tables."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
    place = nation.join(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region")), "r_regionkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).join(place, "n_nationkey")
    return reports.count_by(rows, "nation", "region", name="customers")


QUERIES = {
    "ledger_names": (
        lambda spark, sf: ledger.names_from_log(user_names(spark, sf)),
        "SELECT DISTINCT 'c' || user_id || '.json' AS source_file FROM events WHERE event_type <> 'view'",
    ),
    "ledger_unseen": (ledger_unseen, f"SELECT * FROM ({_FILES}) WHERE source_file NOT IN ({_USERS})"),
    "ledger_seen": (ledger_seen, f"SELECT * FROM ({_FILES}) WHERE source_file IN ({_USERS})"),
    "ledger_backlog": (
        ledger_backlog,
        f"""SELECT * FROM (SELECT DISTINCT 'c' || o_custkey || '.json' AS source_file FROM orders)
        WHERE source_file NOT IN ({_USERS})""",
    ),
    "ledger_ts_lookup": _lookup(plain_counts=False),
    "ledger_ts_ingest_form": _lookup(plain_counts=True),
    "dim_lookup": (
        customers_by_place,
        "SELECT n_name AS nation, r_name AS region, count(*) AS customers FROM customer "
        "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    ),
}
