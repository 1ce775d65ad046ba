"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans; everything else stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Reports compare the text column event_date with dates. Unreadable days must drop out
    # rather than end the query. The library's own expressions do not depend on this.
    "spark.sql.ansi.enabled": "false",
    # A repeated JSON key keeps its last value instead of failing the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Per-file facts are tens of bytes per row; Spark still compares the real size with this.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build_session(app_name: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; `conf` wins over them. Keys may use __ for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_settings(spark: SparkSession) -> None:
    """Set the one option JSON results depend on, for sessions made elsewhere."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def pin_splits(spark: SparkSession) -> None:
    """Keep file splits the same for every pass of this session.

    Their size otherwise follows the number of cores there happen to be, which changes
    while executors come and go; block numbers must mean the same in each pass.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if they come in fewer splits than that.

    For work that costs far more than moving its input, like parsing a table that is one
    small file. Inputs of any size have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def default_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Use `value` for what runs inside, unless the session has its own."""
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder named by spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The copy survives lost executors, and its file sizes give the optimizer real
    statistics, so a later join broadcasts it only if it is small in fact.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
