"""Databases, raw and gold tables: DDL, appends and inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemill.session import default_setting, materialize
from tidemill.spec import RecordSpec


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")


def gold_ddl(table: str, spec: RecordSpec, location: str) -> str:
    """CREATE TABLE of the dated Parquet table; dropping it leaves the files."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.schema)
    return (
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"OPTIONS ('compression' 'snappy') PARTITIONED BY ({spec.partition.name}) LOCATION '{location}'"
    )


def create_gold_table(spark: SparkSession, table: str, spec: RecordSpec, location: str) -> None:
    spark.sql(gold_ddl(table, spec, location))


def create_raw_table(spark: SparkSession, table: str, location: str) -> None:
    """One text column over the raw files as they are, lineage headers included."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (raw_line string) USING text LOCATION '{location}'")


def state_folder(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """Rows of a partitioned Parquet folder, which is created empty if it is not there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(partition).parquet(path)
    return spark.read.schema(schema).parquet(path)


# Shuffled rows per writing task. Parquet of such rows is many times smaller, so the usual
# 64 MB would leave files of a few megabytes each.
WRITE_TASK_BYTES = "256m"


def row_digest(columns: list[str]) -> Column:
    """A digest of a row's values; nulls, which no column of a record has, count as nothing."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def sample_of(columns: list[str], size: int) -> list[Column]:
    """Aggregates that keep `size` rows: the digests make as many classes, and of each the smallest stays.

    What is kept does not depend on order, splits or the number of tasks, and merges like a minimum;
    fewer rows than `size` may leave classes empty.
    """
    digest = row_digest(columns)
    chosen = F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(size))
    row = F.struct(digest.alias("digest"), *columns)
    return [F.min(F.when(chosen == i, row)).alias(f"sample{i}") for i in range(size)]


def append_sampled(rows: DataFrame, table: str, spec: RecordSpec, size: int = 0) -> tuple[int, list[Row]]:
    """Append by column name to the dated table: the number of rows written, and `size` of them at most.

    insertInto goes by position, so columns are put in table order first. The rebalance
    gathers each day into few files, yet splits a day that is larger than a partition
    should be: a day with a third of all rows becomes many tasks, not one.
    """
    ordered = rows.select(*rows.sparkSession.table(table).columns)
    day = spec.partition.name
    laid_out = ordered.hint("rebalance", F.col(day)).sortWithinPartitions(day, "source_file")
    # Seen behind the shuffle, in the writing tasks, where a lost executor cannot count twice.
    written = Observation()
    seen = laid_out.observe(written, F.count(F.lit(1)).alias("rows"), *sample_of(spec.data_columns, size))
    with default_setting(rows.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", WRITE_TASK_BYTES):
        seen.write.mode("append").insertInto(table)
    found = dict(written.get)
    return found.pop("rows"), [row for row in found.values() if row is not None]


def append_rows(rows: DataFrame, table: str, spec: RecordSpec) -> int:
    """Append by column name to the dated table; returns the number of rows written."""
    return append_sampled(rows, table, spec)[0]


#: Days of a recheck that are named in the filter one by one; more are joined.
NAMED_DAYS = 1_000


def missing_rows(rows: DataFrame, table: str, spec: RecordSpec) -> DataFrame:
    """Rows of `rows` that `table` does not hold yet for their files, duplicates counted.

    For files whose earlier append may have been cut short. The partitions of the days in question
    are read, and of them the files in question count; the multiset difference covers none, some
    and all rows present.
    """
    day = spec.partition.name
    columns = [*spec.data_columns, "source_file"]
    places = materialize(rows.select(day, "source_file").distinct(), "recheck")
    held = rows.sparkSession.table(table)
    days = [r[0] for r in places.select(day).distinct().limit(NAMED_DAYS + 1).collect()]
    if len(days) <= NAMED_DAYS:
        held = held.where(F.col(day).isin(days))
    present = held.join(places, [day, "source_file"], "left_semi")
    return rows.select(*columns).exceptAll(present.select(*columns))


def repair(spark: SparkSession, table: str) -> None:
    """Register partition folders written by others."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {table}")


def tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {database}")


def databases(spark: SparkSession, like: str) -> DataFrame:
    return spark.sql(f"SHOW DATABASES LIKE '{like}'")


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE FORMATTED {table}")
