"""Landing and raw files as frames."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.arraysplit import split_arrays
from tidemill.sources import landing, paths

# Above this a JSON file is cut into chunks rather than read as one value. It only has
# to stay well below the parser's limit for one value (128 MiB).
WHOLE_DOCUMENT_BYTES = 32 * 1024 * 1024


def _file_name() -> Column:
    """Base name as it is on disk; the metadata column has it URL-encoded."""
    name = F.col("_metadata.file_name")
    decoded = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name.contains("%"), decoded).otherwise(name).alias("source_file")


def directly_in(spark: SparkSession, directory: str) -> Column:
    """Whether a listed `path` lies in `directory` itself, not in a folder below."""
    prefix = F.lit(paths.qualified(spark, directory) + "/")
    return F.col("path").startswith(prefix) & ~F.contains(F.substr("path", F.length(prefix) + 1), F.lit("/"))


def list_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(source_file, path, length) of the files directly in `directory`; contents stay unread.

    Folders below, whatever their names, neither add files nor hide any: with the recursive lookup
    Spark does not take `k=v` folders for partitions. Names that begin with `_`, or with `.` if the
    pattern does, are files like others; Spark's listing leaves them out, so that they come from a
    listing of their own, where Python's workers reach the storage (see hidden_files).
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .where(directly_in(spark, directory))
        .select(_file_name(), "path", "length")
    )
    # Tasks are sized by file bytes, which are not read here: a few tasks are plenty.
    listed = listed.coalesce(spark.sparkContext.defaultParallelism)
    where = paths.qualified(spark, directory)
    return listed.unionByName(landing.hidden_files(spark, where, pattern)) if landing.reachable(where) else listed


def hidden_files(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Names that match the pattern and cannot be read: Spark's sources pass over them, and Python's
    workers have no file system for the storage. None, where they have one."""
    if landing.reachable(paths.qualified(spark, directory)):
        return []
    path, system = paths.located(spark, directory)
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "[_.]*"))
    names = [s.getPath().getName() for s in found or () if s.isFile()]
    return sorted(n for n in names if landing.matches(n, pattern))


def is_hidden(path: str) -> bool:
    """Whether Spark's sources pass over a file of this path."""
    return path.rsplit("/", 1)[-1][:1] in ("_", ".")


def existing(spark: SparkSession, found: Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    """Those of the listed (path, length) files that are still there."""
    return [(path, length) for path, length in found if paths.exists(spark, path)]


def _located(paths: str | Sequence[str]) -> str | list[str]:
    """A directory as it is; listed names so that no character is taken for a pattern."""
    if isinstance(paths, str):
        return paths
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths]


def _reader(spark: SparkSession, pattern: str | None) -> DataFrameReader:
    # A file that goes between the listing and the read has no rows; its status says so.
    reader = spark.read.option("ignoreMissingFiles", "true")
    return reader if pattern is None else reader.option("pathGlobFilter", pattern)


def _hidden(spark: SparkSession, found: list[tuple[str, int]], ends: str) -> DataFrame:
    # Bytes become text as they are, like in Spark's text source.
    return landing.read_hidden(spark, found, ends).withColumn("value", F.col("value").cast("string"))


def read_listed(spark: SparkSession, found: Sequence[tuple[str, int]]) -> DataFrame:
    """Lines frame of listed (path, length) files of any names."""
    plain = [path for path, _ in found if not is_hidden(path)]
    parts = [read_lines(spark, plain)] if plain else []
    if hidden := [(path, length) for path, length in found if is_hidden(path)]:
        parts.append(_hidden(spark, hidden, "line").drop("file_size"))
    return reduce(DataFrame.unionByName, parts)


def read_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Lines frame of text files: a directory (with a name pattern) or listed files."""
    return _reader(spark, pattern).text(_located(paths)).select(
        _file_name(),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


def read_pieces(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Text between closing braces, in a form split_arrays takes."""
    return (
        _reader(spark, pattern)
        .option("lineSep", "}")
        .text(_located(paths))
        .select(
            _file_name(),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
            "value",
            F.col("_metadata.file_size").alias("file_size"),
        )
    )


def read_documents(
    spark: SparkSession, files: Iterable[tuple[str, int]], whole_limit: int = WHOLE_DOCUMENT_BYTES
) -> DataFrame:
    """Documents frame of JSON files given as (path, length)."""
    files = list(files)
    zero = F.lit(0).cast("bigint")
    parts, pieces = [], []
    for hidden in (False, True):
        own = [f for f in files if is_hidden(f[0]) == hidden]
        small, large = [f for f in own if f[1] <= whole_limit], [f for f in own if f[1] > whole_limit]
        names = [path for path, _ in small]
        if small and hidden:
            whole = _hidden(spark, small, "file")
            parts.append(whole.select("source_file", zero.alias("block"), zero.alias("chunk"), "value"))
        elif small:
            whole = _reader(spark, None).text(_located(names), wholetext=True)
            parts.append(whole.select(_file_name(), zero.alias("block"), zero.alias("chunk"), "value"))
        if large:
            pieces.append(_hidden(spark, large, "brace") if hidden else read_pieces(spark, [path for path, _ in large]))
    if pieces:
        parts.append(split_arrays(reduce(DataFrame.unionByName, pieces)))
    if not parts:
        return spark.createDataFrame([], "source_file string, block bigint, chunk bigint, value string")
    return reduce(DataFrame.unionByName, parts)
