"""The driver tables as event files: labelled lines from orders, JSON arrays from events.

The tables are clean, so fixed rules on the row number damage rows in every way the
parsers must cope with. Each rule has its counterpart in the SQL next to it, which
works on the tables themselves and never sees the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import spread

LINES_PER_BLOCK = 1000
OBJECTS_PER_FILE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's name, segment, nation and region.

    Joined outwards from orders: each step's other side is a table whose size is known.
    """
    return (
        spread(table(spark, sf_dir, "orders"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def order_file() -> Column:
    """One file per order day."""
    return F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".txt"))


def _rule(number: int) -> Column:
    return F.pmod("o_orderkey", F.lit(20)) == number


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines frame of all orders, one line each, most kinds of damage included.

    Files are per day, event dates per month: the dated table has tens of partitions.
    """
    amount = F.floor("o_totalprice").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-01")
    identity = (
        F.when(_rule(9), F.concat(F.lit("Order: "), F.col("o_orderkey").cast("string")))
        .when(_rule(10), "Event ID:")
        .when(_rule(11), "Event ID: ")
        .otherwise(F.concat(F.lit("Event ID: E"), F.col("o_orderkey").cast("string")))
    )
    attendance = (
        F.when(_rule(0), F.format_string("Attendance: %,d", F.floor("o_totalprice")))
        .when(_rule(1), "Attendance: n/a")
        .when(_rule(2), "Attendance: 42.5")
        .when(_rule(3), F.lit(None))
        .when(_rule(13), F.concat(F.lit("Attendance:  +"), amount, F.lit(" ")))
        .when(_rule(14), "Attendance: 1_234")
        .when(_rule(15), "Attendance: 99999999999999999999")
        .otherwise(F.concat(F.lit("Attendance: "), amount))
    )
    dated = (
        F.when(_rule(4), "Event Date: 1997-5-1")
        .when(_rule(5), F.lit(None))
        .when(_rule(12), "Event Date: abcdefghij")
        .otherwise(F.concat(F.lit("Event Date: "), day))
    )
    hall = F.when(_rule(7), F.concat(F.lit("Hall: "), "n_name")).otherwise(F.col("n_name"))
    parts = F.concat_ws(
        " | ",
        identity,
        F.concat(F.lit("Event Name: "), "c_name"),
        F.concat(F.lit("Sport: "), "c_mktsegment"),
        F.concat(F.lit("Venue: "), hall),
        F.when(_rule(16), F.lit(None)).otherwise(F.concat(F.lit("City: "), "r_name")),
        F.lit("Country: Atlantis"),
        dated,
        F.concat(F.lit("Team A: "), "o_orderpriority"),
        F.lit("Team B: \u00a0guests\t"),
        F.when(_rule(6), "Status: overwritten"),
        F.concat(F.lit("Status: "), "o_orderstatus"),
        attendance,
    )
    framed = F.when(_rule(8), F.concat(F.lit("\t \u2003"), parts, F.lit("\u3000\t"))).otherwise(parts)
    return order_details(spark, sf_dir).select(
        order_file().alias("source_file"),
        F.floor(F.col("o_orderkey") / LINES_PER_BLOCK).alias("block"),
        F.col("o_orderkey").alias("line_no"),
        framed.alias("value"),
    )


# What the lines of `order_lines` must parse to, from the tables alone.
ORDERS_SQL = """
details AS (
  SELECT o.*, o_orderkey % 20 AS rule, c_name, c_mktsegment, n_name, r_name,
         CAST(floor(o_totalprice) AS BIGINT) AS amount
  FROM orders o JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
parsed AS (
  SELECT o_orderkey AS line_no,
    CASE WHEN rule = 11 THEN '' ELSE 'E' || o_orderkey END AS event_id,
    c_name AS event_name, c_mktsegment AS sport_type,
    CASE WHEN rule = 7 THEN 'Hall: ' || n_name ELSE n_name END AS venue,
    CASE WHEN rule = 16 THEN '' ELSE r_name END AS city,
    'Atlantis' AS country, o_orderpriority AS team_a, 'guests' AS team_b, o_orderstatus AS status,
    CASE WHEN rule IN (1, 2, 3, 15) THEN 0 WHEN rule = 14 THEN 1234 ELSE amount END AS attendance,
    'orders_' || strftime(o_orderdate, '%Y%m%d') || '.txt' AS source_file,
    CASE WHEN rule IN (4, 5) THEN '1900-01-01' WHEN rule = 12 THEN 'abcdefghij'
         ELSE strftime(o_orderdate, '%Y-%m-01') END AS event_date
  FROM details WHERE rule NOT IN (9, 10)
)"""


def event_file() -> Column:
    """One file per run of consecutive events."""
    return F.format_string("events_%08d.json", F.floor(F.col("event_id") / OBJECTS_PER_FILE))


def _case(rules: dict[int, str | Column | None], number: Column, otherwise: Column) -> Column:
    chain = None
    for rule, value in rules.items():
        column = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(number == rule, column) if chain is None else chain.when(number == rule, column)
    return chain.otherwise(otherwise)


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): every event as JSON text of an array element, some damaged.

    A member missing by rule is NULL among the parts, which concat_ws leaves out.
    """
    number = F.pmod("event_id", F.lit(23))
    text = F.col("event_id").cast("string")
    value = F.col("value")
    priority = F.when(value >= 100, "High").when(value >= 30, "Medium").otherwise("Low")
    day = F.date_format("ts", "yyyy-MM-dd")
    metadata = F.concat(
        F.lit('"metadata": {"source_system": "sys '),
        F.pmod("user_id", F.lit(4)).cast("string"),
        F.lit('", "priority": "'),
        priority,
        F.lit('", '),
        _case(
            {8: '"broadcast": "true", ', 9: '"broadcast": 1, ', 10: ""},
            number,
            F.concat(F.lit('"broadcast": '), (value >= 50).cast("string"), F.lit(", ")),
        ),
        F.lit('"category": "'),
        F.col("event_type"),
        F.lit('", "referee": "user '),
        F.col("user_id").cast("string"),
        F.lit('", "notes": '),
        F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.lit("}"),
    )
    members = F.concat_ws(
        ", ",
        F.concat(F.lit('"event_id": "E'), text, F.lit('"')),
        F.lit('"event_name": "match \\"one\\" {a}, [b]"'),
        F.concat(F.lit('"sport": "'), "event_type", F.lit('"')),
        _case(
            {1: None, 2: '"venue": null', 3: '"venue": true', 4: '"venue": 17'},
            number,
            F.concat(F.lit('"venue": "user '), F.col("user_id").cast("string"), F.lit('"')),
        ),
        F.lit('"city": "C", "country": "Q"'),
        _case(
            {5: '"event_date": null', 6: '"event_date": "2024-1-5"', 7: None},
            number,
            F.concat(F.lit('"event_date": " '), day, F.lit(' "')),
        ),
        F.lit('"team_a": "A", "team_b": "B", "status": "first"'),
        F.lit('"status": "last"'),
        _case(
            {
                11: None,
                12: '"attendance": 42.7',
                13: '"attendance": true',
                14: '"attendance": "42"',
                15: '"attendance": "1,000"',
                16: '"attendance": null',
                17: '"attendance": [3]',
                18: '"attendance": "42.5"',
            },
            number,
            F.concat(F.lit('"attendance": '), text),
        ),
        _case({19: '"metadata": null', 20: '"metadata": [1]', 21: None}, number, metadata),
    )
    element = F.when(number == 22, text).otherwise(F.concat(F.lit("{"), members, F.lit("}")))
    return spread(table(spark, sf_dir, "events")).select("event_id", element.alias("value"))


def events_sql(per_file: int = OBJECTS_PER_FILE) -> str:
    """What `event_documents` must parse to, from the table alone."""
    return f"""
elements AS (
  SELECT *, event_id % 23 AS rule, strftime(ts, '%Y-%m-%d') AS day,
    'events_' || lpad(CAST(event_id // {per_file} AS VARCHAR), 8, '0') || '.json' AS source_file,
    (event_id // {per_file}) % 13 AS file_rule
  FROM events
),
objects AS (SELECT * FROM elements WHERE rule <> 22 AND file_rule NOT IN (1, 2, 3)),
parsed AS (
  SELECT 'E' || event_id AS event_id, 'match "one" {{a}}, [b]' AS event_name, event_type AS sport_type,
    CASE rule WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN 'True' WHEN 4 THEN '17'
         ELSE 'user ' || user_id END AS venue,
    'C' AS city, 'Q' AS country, 'A' AS team_a, 'B' AS team_b, 'last' AS status,
    CASE WHEN rule IN (11, 15, 16, 17, 18) THEN 0 WHEN rule IN (12, 14) THEN 42 WHEN rule = 13 THEN 1
         ELSE event_id END AS attendance,
    CASE WHEN rule IN (19, 20, 21) THEN '' ELSE 'sys ' || (user_id % 4) END AS meta_source_system,
    CASE WHEN rule IN (19, 20, 21) THEN '' WHEN value >= 100 THEN 'High' WHEN value >= 30 THEN 'Medium'
         ELSE 'Low' END AS meta_priority,
    CASE WHEN rule IN (8, 9, 10, 19, 20, 21) THEN 'false' WHEN value >= 50 THEN 'true'
         ELSE 'false' END AS meta_broadcast,
    CASE WHEN rule IN (19, 20, 21) THEN '' ELSE event_type END AS meta_category,
    CASE WHEN rule IN (19, 20, 21) THEN '' ELSE 'user ' || user_id END AS meta_referee,
    CASE WHEN rule IN (19, 20, 21) THEN '' ELSE props END AS meta_notes,
    source_file,
    CASE WHEN rule IN (5, 6, 7) THEN '1900-01-01' ELSE day END AS event_date
  FROM objects
)"""


def event_documents(spark: SparkSession, sf_dir: str, per_file: int = OBJECTS_PER_FILE) -> DataFrame:
    """Documents frame of event files; by file number some are not one JSON array."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    file_no = F.floor(F.col("event_id") / per_file).alias("file_no")
    body = F.array_join(F.transform(ordered, lambda o: o["value"]), ",\n  ")
    rule = F.pmod("file_no", F.lit(13))
    document = (
        F.when(rule == 1, F.concat(F.lit('{"items": ['), "body", F.lit("]}")))
        .when(rule == 2, F.concat(F.lit("[\n  "), "body", F.lit("\n")))
        .when(rule == 3, F.concat(F.lit("[\n  "), "body", F.lit("\n] trailing")))
        .otherwise(F.concat(F.lit("[\n  "), "body", F.lit("\n]\n")))
    )
    # event_id is unique, so a file gathers at most per_file objects.
    return (
        event_objects(spark, sf_dir)
        .groupBy(file_no)
        .agg(body.alias("body"))
        .select(
            F.format_string("events_%08d.json", "file_no").alias("source_file"),
            F.lit(0).cast("bigint").alias("block"),
            F.lit(0).cast("bigint").alias("chunk"),
            document.alias("value"),
        )
    )
