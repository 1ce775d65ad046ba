"""Queries that go through real files and tables in the shared scratch folder."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import documents, labeled, ledger, reports, status
from tidemill.operators.arraysplit import split_arrays
from tidemill.plans.load import (
    JSON,
    PROCESSED,
    STARTED,
    TEXT,
    Store,
    archive_processed,
    ingest_directory,
    load_directory,
    load_raw,
)
from tidemill.queries.landing import ORDERS_SQL, event_documents, events_sql, order_lines, table
from tidemill.queries.text_lane import parsed_orders, stamped_order_lines
from tidemill.session import materialize, scratch_dir
from tidemill.sources import files as sources
from tidemill.sources import paths, tables
from tidemill.sources.ledger_files import LedgerFiles
from tidemill.spec import HEADER_MARKER, JSON_RECORD, TEXT_RECORD
from tidemill.streaming.incremental import load_new

RUN_TS = "2026-04-01 00:00:00"
LATER_TS = "2026-04-01 01:00:00"
LARGE_FILE_OBJECTS = 500
GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _new_table(spark: SparkSession, spec=TEXT_RECORD) -> tuple[str, str]:
    """A new empty dated table and the folder it and its state live in."""
    base = scratch_dir(spark, "tables")
    tables.create_database(spark, "tidemill_scratch", f"{base}/db")
    name = f"tidemill_scratch.events_{uuid.uuid4().hex}"
    tables.create_gold_table(spark, name, spec, f"{base}/gold")
    return name, base


def _write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files, cut as the rows happen to be partitioned."""
    lines.select("value").write.mode("append").text(path)


def _write_documents(documents_frame: DataFrame, path: str) -> None:
    """One file per document."""
    documents_frame.select("value").write.option("maxRecordsPerFile", 1).text(path)


def _write_joined(documents_frame: DataFrame, path: str) -> None:
    """Documents one after the other, as many to a file as a task has: for readers of lines, who see the same
    lines as in one file per document."""
    documents_frame.select("value").write.text(path)


def _early(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("source_file") < "orders_19980101")


def _lineage(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ingest_ts": F.lit("i"), "processing_ts": F.lit("p")})


def _gold_table(spark: SparkSession, sf_dir: str) -> str:
    """Parsed orders appended by name to a new dated table."""
    name, _ = _new_table(spark)
    tables.append_rows(_lineage(parsed_orders(spark, sf_dir)), name, TEXT_RECORD)
    return name


PARTS = 4


def _named_files(spark: SparkSession, lines: DataFrame, names: Column, landing: str) -> None:
    """Text files by name, some thousands at most, of the lines (value) that `names` gives to each."""
    written = scratch_dir(spark, "by_name")
    lines.select(names.alias("name"), "value").repartition("name").write.partitionBy("name").text(written)
    for folder in paths.names_in(spark, written):
        for part in paths.names_in(spark, f"{written}/{folder}") if folder.startswith("name=") else ():
            if part.startswith("part-"):
                paths.rename(spark, f"{written}/{folder}/{part}", f"{landing}/{folder.removeprefix('name=')}")


def landing_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and length of every landing file: the documents as text files by source and part, some with underscores."""
    landing = scratch_dir(spark, "landing")
    docs = table(spark, sf_dir, "documents")
    part = F.pmod("doc_id", F.lit(PARTS))
    name = F.concat(F.when(part == 1, "_").otherwise(""), "source", F.format_string("-%d.txt", part))
    _named_files(spark, docs.withColumn("value", F.col("text")), name, landing)
    return sources.list_files(spark, landing, "*.txt").select("source_file", "length")


def underscored_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by month in files half of which begin with an underscore: batch load of some, stream of the rest."""
    landing = scratch_dir(spark, "landing")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    lines = order_lines(spark, sf_dir)
    month = F.substr("source_file", F.lit(8), F.lit(6))
    file = F.concat(F.when(F.pmod(F.substr(month, F.lit(5)).cast("int"), F.lit(2)) == 1, "_").otherwise(""), month, F.lit(".txt"))
    early = F.col("source_file") < "orders_19980101"
    _named_files(spark, lines.where(early), file, landing)
    load_directory(spark, landing, TEXT, name, store, RUN_TS)
    _named_files(spark, lines.where(~early), file, landing)
    load_new(spark, landing, TEXT, name, store, f"{base}/checkpoint", LATER_TS).awaitTermination()
    spark.catalog.refreshTable(name)
    return spark.table(name).groupBy("source_file", "processing_ts").agg(F.count("*").alias("records"), F.sum("attendance").alias("attendance"))


def archive_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each landing file is after a load with an archive: files without a record stay."""
    landing, archive = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    lines = order_lines(spark, sf_dir)
    record = F.col("value").contains("Event ID: ")
    file = F.concat(F.when(record, "").otherwise("_rejects_"), F.substr("source_file", F.lit(8), F.lit(4)), F.lit(".txt"))
    _named_files(spark, lines, file, landing)
    load_directory(spark, landing, TEXT, name, store, RUN_TS)
    archive_processed(spark, landing, TEXT, store, archive)
    places = [sources.list_files(spark, folder, "*.txt").select(F.lit(place).alias("place"), "source_file") for place, folder in (("archive", archive), ("landing", landing))]
    return places[0].unionByName(places[1])


def load_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a load keeps to be looked at, picked by the pass that writes them."""
    landing = scratch_dir(spark, "landing")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    _write_lines(order_lines(spark, sf_dir), landing)
    load_directory(spark, landing, TEXT, name, store, RUN_TS)
    return store.sample(spark, TEXT_RECORD).drop("run_id")


def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers not in the ledger, which has merged a mark per event type into bucketed runs."""
    files = LedgerFiles(f"{scratch_dir(spark, 'state')}/ledger")
    events = table(spark, sf_dir, "events")
    named = F.format_string("c%d.json", "user_id").alias("source_file")
    for (kind,) in events.select("event_type").distinct().orderBy("event_type").collect():
        seen = events.where(F.col("event_type") == kind).select(named).distinct()
        files.append(ledger.entries(seen, PROCESSED, RUN_TS, kind))
        files.merge(spark, most=1)
    customers = table(spark, sf_dir, "customer").select(F.format_string("c%d.json", "c_custkey").alias("source_file"))
    return ledger.unseen(customers, ledger.at_stage(files.read(spark, customers), PROCESSED))


def raw_preview_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First elements that are no objects in the raw table over JSON files."""
    path = scratch_dir(spark, "raw")
    _write_joined(event_documents(spark, sf_dir), path)
    name = f"raw_{uuid.uuid4().hex}"
    tables.create_raw_table(spark, name, path)
    odd = F.col("raw_line").rlike("^  [0-9]+,?$")
    return reports.listing(spark.table(name), ["raw_line"], odd, order=["raw_line"], limit=3)


def catalog_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the given tables, by way of the catalog: a database is made, listed, and its tables described."""
    base = scratch_dir(spark, "catalog")
    database = f"tidemill_catalog_{uuid.uuid4().hex[:8]}"
    tables.create_database(spark, database, f"{base}/db")
    for given in GIVEN:
        spark.sql(f"CREATE TABLE {database}.{given} USING parquet LOCATION '{paths.qualified(spark, f'{sf_dir}/{given}.parquet')}'")
    found = [row["namespace"] for row in tables.databases(spark, database).collect()]
    described = None
    for row in tables.tables(spark, found[0]).collect():  # as many as tables are given
        own = tables.describe(spark, f"{database}.{row['tableName']}").withColumn("row", F.monotonically_increasing_id())
        first_note = own.where("col_name = ''").agg(F.min("row").alias("end"))
        columns = own.join(first_note, own["row"] < first_note["end"]).select(F.lit(row["tableName"]).alias("table_name"), "col_name", "data_type")
        described = columns if described is None else described.unionByName(columns)
    return described


def raw_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lineage headers in the raw table, which shows the files' lines as they are."""
    path = scratch_dir(spark, "raw")
    _write_lines(stamped_order_lines(spark, sf_dir), path)
    name = f"raw_{uuid.uuid4().hex}"
    tables.create_raw_table(spark, name, path)
    headers = F.col("raw_line").startswith(HEADER_MARKER)
    return reports.listing(spark.table(name), ["raw_line"], headers, order=["raw_line"], limit=5)


def text_files_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines through text files and back."""
    path = scratch_dir(spark, "landing")
    _write_lines(order_lines(spark, sf_dir), path)
    lines = sources.read_lines(spark, path, "*.txt")
    return labeled.records(labeled.classify(lines)).select(*TEXT_RECORD.data_columns)


def json_files_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files, all read as if too large for one value."""
    path = scratch_dir(spark, "landing")
    _write_documents(event_documents(spark, sf_dir, LARGE_FILE_OBJECTS), path)
    # Cut up and parsed once, for the facts and for the rows.
    chunks = documents.parsed(split_arrays(sources.read_pieces(spark, path, "*.txt"))).drop("value")
    chunks = materialize(chunks, "chunks")
    facts = status.block_facts(materialize(documents.block_summary(chunks), "blocks")).where("loads")
    rows = documents.records(chunks).join(facts, ["source_file", "block"], "left_semi")
    return rows.select(*JSON_RECORD.data_columns)


def gold_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed orders through the dated table."""
    return spark.table(_gold_table(spark, sf_dir))


def partition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.partitions(spark, _gold_table(spark, sf_dir))


def repair_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition folders written behind the table's back count after a repair."""
    name, base = _new_table(spark)
    ordered = _lineage(parsed_orders(spark, sf_dir)).select(*TEXT_RECORD.columns)
    ordered.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(f"{base}/gold")
    tables.repair(spark, name)
    return spark.table(name).groupBy("event_date").agg(F.count("*").alias("n"))


def upcoming_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day filter on the table, where it prunes partitions."""
    rows = spark.table(_gold_table(spark, sf_dir))
    columns = ("event_date", "event_id", "venue", "attendance")
    order = ("event_date", "event_id", "source_file", "attendance")
    return reports.upcoming(rows, F.to_date(F.lit("2000-01-01")), columns, order=order)


def _step(number: int, name: str, spark: SparkSession) -> DataFrame:
    spark.catalog.refreshTable(name)
    return spark.table(name).agg(F.count("*").alias("records"), F.sum("attendance").alias("attendance")).select(
        F.lit(number).alias("step"), "records", "attendance"
    )


def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream over landing files: first files, a rerun without news, then the rest."""
    landing = scratch_dir(spark, "landing")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    lines = order_lines(spark, sf_dir)
    states = []
    waves = [_early(lines), None, lines.where(F.col("source_file") >= "orders_19980101")]
    for number, wave in enumerate(waves, start=1):
        if wave is not None:
            _write_lines(wave, landing)
        load_new(spark, landing, TEXT, name, store, f"{base}/checkpoint", RUN_TS).awaitTermination()
        states.append(_step(number, name, spark).first())
    return spark.createDataFrame(states, "step int, records bigint, attendance bigint")


def batch_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch load with the ledger, run again, then again with more files; table at the end."""
    landing = scratch_dir(spark, "landing")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    lines = order_lines(spark, sf_dir)
    _write_lines(_early(lines), landing)
    load_directory(spark, landing, TEXT, name, store, RUN_TS)
    load_directory(spark, landing, TEXT, name, store, "2026-04-01 00:30:00")
    _write_lines(lines.where(F.col("source_file") >= "orders_19980101"), landing)
    load_directory(spark, landing, TEXT, name, store, LATER_TS)
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*TEXT_RECORD.data_columns)


def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load cut short: files noted as started, part of their rows in the table."""
    landing = scratch_dir(spark, "landing")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    _write_lines(order_lines(spark, sf_dir), landing)
    rows = labeled.records(labeled.classify(sources.read_lines(spark, landing, "*.txt")))
    written = rows.withColumns({"ingest_ts": F.lit("unknown"), "processing_ts": F.lit("crashed")})
    tables.append_rows(written.where(F.col("status") == "F"), name, TEXT_RECORD)
    names = sources.list_files(spark, landing, "*.txt").select("source_file")
    store.mark(names, STARTED, RUN_TS, "crashed")
    load_directory(spark, landing, TEXT, name, store, LATER_TS)
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*TEXT_RECORD.data_columns)


def raw_zone_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing files copied to the raw zone, then loaded: every row has its file's ingest time."""
    landing, raw = scratch_dir(spark, "landing"), scratch_dir(spark, "raw")
    name, base = _new_table(spark)
    store = Store(f"{base}/state")
    _write_lines(order_lines(spark, sf_dir), landing)
    ingest_directory(spark, landing, TEXT, raw, store, RUN_TS)
    load_raw(spark, TEXT, raw, name, store, LATER_TS)
    spark.catalog.refreshTable(name)
    return spark.table(name).groupBy("ingest_ts", "processing_ts").agg(F.count("*").alias("records"))


def raw_zone_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files through ingest and load: broken files never get in."""
    landing, raw = scratch_dir(spark, "landing"), scratch_dir(spark, "raw")
    name, base = _new_table(spark, JSON_RECORD)
    store = Store(f"{base}/state")
    _write_documents(event_documents(spark, sf_dir, LARGE_FILE_OBJECTS), landing)
    lane = replace(JSON, pattern="*.txt")  # the text writer names its files so
    ingest_directory(spark, landing, lane, raw, store, RUN_TS)
    load_raw(spark, lane, raw, name, store, LATER_TS)
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*JSON_RECORD.data_columns, "ingest_ts")


_PARSED_COLUMNS = ", ".join(TEXT_RECORD.data_columns)
_JSON_COLUMNS = ", ".join(JSON_RECORD.data_columns)


def _with(sql: str) -> str:
    return f"WITH {ORDERS_SQL}\n{sql}"


def _steps_sql() -> str:
    early = "source_file < 'orders_19980101'"
    state = "count(*) AS records, CAST(sum(attendance) AS BIGINT) AS attendance FROM parsed"
    return _with(
        f"SELECT 1 AS step, {state} WHERE {early} UNION ALL SELECT 2, {state} WHERE {early} "
        f"UNION ALL SELECT 3, {state}"
    )


def _sample_sql(size: int) -> str:
    digest = "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in TEXT_RECORD.data_columns) + "))"
    return f"""SELECT {_PARSED_COLUMNS} FROM (SELECT *, {digest} AS digest FROM parsed)
    QUALIFY row_number() OVER (PARTITION BY ('0x' || substr(digest, 1, 8))::BIGINT % {size} ORDER BY digest) = 1"""


QUERIES = {
    "landing_listing": (
        landing_listing,
        f"""SELECT CASE WHEN doc_id % {PARTS} = 1 THEN '_' ELSE '' END || source || '-' || doc_id % {PARTS} || '.txt' AS source_file,
        CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM documents GROUP BY ALL""",
    ),
    "underscored_load": (
        underscored_load,
        _with(
            """SELECT CASE WHEN CAST(m[5:] AS INTEGER) % 2 = 1 THEN '_' ELSE '' END || m || '.txt' AS source_file,
            CASE WHEN m < '199801' THEN '"""
            + RUN_TS
            + "' ELSE '"
            + LATER_TS
            + """' END AS processing_ts, count(*) AS records, CAST(sum(attendance) AS BIGINT) AS attendance
            FROM (SELECT *, substr(source_file, 8, 6) AS m FROM parsed) GROUP BY ALL"""
        ),
    ),
    "archive_consumed": (
        archive_consumed,
        """SELECT DISTINCT CASE WHEN o_orderkey % 20 IN (9, 10) THEN 'landing' ELSE 'archive' END AS place,
        CASE WHEN o_orderkey % 20 IN (9, 10) THEN '_rejects_' ELSE '' END || year(o_orderdate) || '.txt' AS source_file FROM orders""",
    ),
    "load_sample": (load_sample, _with(_sample_sql(3))),
    "ledger_buckets": (
        ledger_buckets,
        """SELECT 'c' || c_custkey || '.json' AS source_file FROM customer
        WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    ),
    "raw_preview_json": (
        raw_preview_json,
        """SELECT '  ' || event_id || CASE WHEN event_id % 20 = 19 OR event_id = (SELECT max(event_id) FROM events) THEN '' ELSE ',' END
        AS raw_line FROM events WHERE event_id % 23 = 22 ORDER BY 1 LIMIT 3""",
    ),
    "catalog_inspect": (
        catalog_inspect,
        f"""SELECT table_name, column_name AS col_name,
        CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type
        FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in GIVEN)})""",
    ),
    "raw_preview": (
        raw_preview,
        """SELECT '##INGEST_METADATA## source_file=orders_' || strftime(d, '%Y%m%d') || '.txt ingest_ts='
          || strftime(d, '%Y-%m-%d') || ' 06:00:00' AS raw_line
        FROM (SELECT DISTINCT o_orderdate AS d FROM orders WHERE year(o_orderdate) > 1995) ORDER BY 1 LIMIT 5""",
    ),
    "text_files_parse": (text_files_parse, _with(f"SELECT {_PARSED_COLUMNS} FROM parsed")),
    "json_files_split": (
        json_files_split,
        f"WITH {events_sql(LARGE_FILE_OBJECTS)} SELECT {_JSON_COLUMNS} FROM parsed",
    ),
    "gold_roundtrip": (
        gold_roundtrip,
        _with(f"SELECT {_PARSED_COLUMNS}, source_file, 'i' AS ingest_ts, 'p' AS processing_ts FROM parsed"),
    ),
    "partition_list": (
        partition_list,
        _with("SELECT DISTINCT 'event_date=' || event_date AS partition FROM parsed"),
    ),
    "repair_partitions": (
        repair_partitions,
        _with("SELECT event_date, count(*) AS n FROM parsed GROUP BY event_date"),
    ),
    "upcoming_from_table": (
        upcoming_from_table,
        _with(
            "SELECT event_date, event_id, venue, attendance FROM parsed "
            "WHERE TRY_CAST(event_date AS DATE) >= DATE '2000-01-01' "
            "ORDER BY event_date, event_id, source_file, attendance LIMIT 20"
        ),
    ),
    "incremental_load": (incremental_load, _steps_sql()),
    "batch_rerun": (batch_rerun, _with(f"SELECT {_PARSED_COLUMNS} FROM parsed")),
    "crash_recovery": (crash_recovery, _with(f"SELECT {_PARSED_COLUMNS} FROM parsed")),
    "raw_zone_load": (
        raw_zone_load,
        _with(
            f"SELECT '{RUN_TS}' AS ingest_ts, '{LATER_TS}' AS processing_ts, count(*) AS records FROM parsed"
        ),
    ),
    "raw_zone_json": (
        raw_zone_json,
        f"WITH {events_sql(LARGE_FILE_OBJECTS)} SELECT {_JSON_COLUMNS}, '{RUN_TS}' AS ingest_ts FROM parsed",
    ),
}
