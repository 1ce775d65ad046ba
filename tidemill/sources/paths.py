"""Names, small texts and moves by Spark's own file systems; contents of data files never pass here."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The Hadoop path with scheme, as it stands before the names Spark lists, and its file system."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = plain.getFileSystem(spark._jsc.hadoopConfiguration())
    return plain.makeQualified(system.getUri(), system.getWorkingDirectory()), system


def qualified(spark: SparkSession, path: str) -> str:
    return located(spark, path)[0].toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where, system = located(spark, path)
    return system.exists(where)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that holds few; none, if it is not there."""
    where, system = located(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder; 0, if there is none."""
    where, system = located(spark, path)
    return system.getContentSummary(where).getLength() if system.exists(where) else 0


def read_text(spark: SparkSession, path: str) -> str:
    where, system = located(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that is whole as soon as it is there; False if there is one by that name."""
    where, system = located(spark, path)
    if system.exists(where):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"draft-{uuid.uuid4().hex}")
    stream = system.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.rename(draft, where):
        return True
    system.delete(draft, False)
    return False


def remove(spark: SparkSession, path: str) -> None:
    where, system = located(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a file a name of its own, in whatever folder."""
    (where, system), (there, _) = located(spark, path), located(spark, to)
    system.mkdirs(there.getParent())
    if not system.rename(where, there):
        raise RuntimeError(f"{path} cannot be renamed to {to}")


def move_into(spark: SparkSession, path: str, folder: str) -> bool:
    """Move a file into a folder, over an older one of its name; False if it is gone already."""
    where, system = located(spark, path)
    target, _ = located(spark, folder)
    if not system.exists(where):
        return False
    system.mkdirs(target)
    there = spark._jvm.org.apache.hadoop.fs.Path(target, where.getName())
    if system.exists(there):
        system.delete(there, False)
    if not system.rename(where, there):
        raise RuntimeError(f"{path} cannot be moved to {folder}")
    return True
