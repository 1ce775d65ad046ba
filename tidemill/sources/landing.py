"""The landing directory as a Python data source: every name is a file, whatever it begins with.

Spark's own file sources pass over names that begin with `_` or `.`. This source lists a directory flat
in a task (`what=files`), reads such files' contents in splits (`what=pieces`), and as a stream says when
the listing has changed: its offset is a digest of the listing, of the same size however many files
there are. Which of the files are new is the ledger's affair, so a repeated micro-batch needs no record
of the names it had.

Tasks reach storage by pyarrow's file systems. The classes travel to the workers by value: these need
not have this package.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "tidemill_landing"
FILES = "source_file string, path string, length bigint"
PIECES = "source_file string, block bigint, line_no bigint, value binary, file_size bigint"
#: Bytes of a split, and of one read within it.
SPLIT_BYTES, READ_BYTES = 128 << 20, 8 << 20
#: In the message of a file that cannot be read.
UNREADABLE = "UNREADABLE_FILE"

#: What ends a piece, by name: a line as text files have them, or a closing brace. None: the file is one piece.
_ENDS = {"line": rb"\r\n|\n|\r", "brace": rb"\}", "file": None}
_MARK = b"\xef\xbb\xbf"


def file_system(path: str):
    """pyarrow's file system for a path with or without scheme, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether Python's workers have a file system for the path's scheme."""
    try:
        file_system(path)
    except Exception:  # a scheme pyarrow doesn't know, or one whose library is not installed
        return False
    return True


def matches(name: str, pattern: str) -> bool:
    """Shell rules: a leading dot has to be in the pattern, a leading underscore is like any character."""
    import fnmatch

    return fnmatch.fnmatchcase(name, pattern) and (not name.startswith(".") or pattern.startswith("."))


def listing(directory: str, pattern: str) -> list[tuple[str, str, int]]:
    """(name, path, length) of the files directly in the directory."""
    from pyarrow import fs

    system, root = file_system(directory)
    found = system.get_file_info(fs.FileSelector(root, recursive=False))
    return [(f.base_name, f"{directory}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and matches(f.base_name, pattern)]


def pieces(read, size: int, start: int, end: int, ends: bytes | None) -> Iterator[bytes]:
    """The pieces that begin in [start, end) of a file; `read(at, n)` returns up to n of its bytes.

    A text's byte order mark is no part of its first line. What follows the last end is a piece, if it
    is not empty.
    """
    import re

    if ends is None:
        yield b"".join(read(at, READ_BYTES) for at in range(0, size, READ_BYTES))
        return
    search = re.compile(ends).finditer
    # From `at` on bytes are read; `base` is where `data` begins. A mark belongs to the first line.
    at = base = start - 1 if start else len(_MARK) * (read(0, len(_MARK)) == _MARK)
    data, skipping, first = b"", start > 0, start == 0
    while at < size or data:
        more = read(at, READ_BYTES) if at < size else b""
        at += len(more)
        last = at >= size or not more
        data += more
        done = 0
        for found in search(data):
            if found.end() == len(data) and not last:
                break  # a carriage return whose line feed may come with the next read
            if not skipping:
                if base + done >= end and not first:
                    return
                yield data[done : found.start()]
            skipping = first = False
            done = found.end()
        data, base = data[done:], base + done
        if last:
            if data and not skipping and (base < end or first):
                yield data
            return


class _Whole(InputPartition):
    """A listing, which is one task."""


class _Splits(InputPartition):
    """(path, size, start, end) of pieces of files."""

    def __init__(self, splits: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.splits = splits


def deal(files: list[tuple[str, int]], whole: bool) -> list[_Splits]:
    """Files cut into splits, small ones put together up to the size of one."""
    out: list[_Splits] = []
    held, room = [], 0
    for path, size in files:
        step = max(size, 1) if whole else SPLIT_BYTES
        for start in range(0, max(size, 1), step):
            length = min(step, size - start)
            if held and room < length:
                out.append(_Splits(held))
                held, room = [], 0
            if not held:
                room = SPLIT_BYTES
            held.append((path, size, start, start + length))
            room -= length
    return [*out, _Splits(held)] if held else out


class FilesReader(DataSourceReader):
    """The listing, or with `hidden` only what Spark's sources pass over."""

    def __init__(self, options: dict):
        self.directory, self.pattern = options["directory"], options["pattern"]
        self.hidden = options.get("hidden") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Whole(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in listing(self.directory, self.pattern):
            if not self.hidden or row[0][0] in "_.":
                yield row


class PiecesReader(DataSourceReader):
    """The contents of the files given, in pieces."""

    def __init__(self, options: dict):
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.ends = _ENDS[options["ends"]]

    def partitions(self) -> list[InputPartition]:
        return deal(self.files, self.ends is None) or [_Splits([])]

    def read(self, partition: _Splits) -> Iterator:
        import pyarrow as pa

        names = ["source_file", "block", "line_no", "value", "file_size"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for path, size, start, end in partition.splits:
            name = path.rsplit("/", 1)[-1]
            try:
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    for number, value in enumerate(pieces(lambda at, n, f=file: f.read_at(n, at), size, start, end, self.ends)):
                        rows.append((name, start, number, value, size))
                        held += len(value) + 64
                        if held > READ_BYTES:
                            yield batch()
                            rows, held = [], 0
            except FileNotFoundError:
                continue  # gone since it was listed: no rows, as with Spark's sources
            except OSError as error:
                raise OSError(f"{UNREADABLE} {path}: {error}") from error
        if rows:
            yield batch()


class ListingStream(DataSourceStreamReader):
    """The whole listing, whenever it differs from the last one or another run begins."""

    def __init__(self, options: dict):
        self.directory, self.pattern, self.run = options["directory"], options["pattern"], options["run"]

    def initialOffset(self) -> dict:
        return {"files": 0, "digest": "", "run": ""}

    def latestOffset(self) -> dict:
        import hashlib

        total, files = 0, 0
        for name, _, length in listing(self.directory, self.pattern):
            # A sum of hashes: the order of the listing doesn't matter.
            total += int.from_bytes(hashlib.sha256(f"{name}/{length}".encode("utf-8", "surrogateescape")).digest()[:16], "big")
            files += 1
        return {"files": files, "digest": f"{total % (1 << 128):032x}", "run": self.run}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Whole(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from listing(self.directory, self.pattern)

    def commit(self, end: dict) -> None:
        """Nothing: the ledger knows what has been loaded."""


class Landing(DataSource):
    """Options: what (files or pieces), and those of the readers."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIECES if self.options.get("what") == "pieces" else FILES

    def reader(self, schema) -> DataSourceReader:
        return PiecesReader(self.options) if self.options.get("what") == "pieces" else FilesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Landing)


def hidden_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(source_file, path, length) of the files whose names Spark's sources pass over."""
    register(spark)
    reader = spark.read.format(NAME).option("what", "files").option("hidden", "true")
    return reader.option("directory", directory).option("pattern", pattern).load()


def read_hidden(spark: SparkSession, files: list[tuple[str, int]], ends: str) -> DataFrame:
    """Pieces (source_file, block, line_no, value, file_size) of such files, given as (path, length)."""
    register(spark)
    reader = spark.read.format(NAME).option("what", "pieces").option("ends", ends)
    return reader.option("files", json.dumps(files)).load()


def listings(spark: SparkSession, directory: str, pattern: str, run: str) -> DataFrame:
    """Stream of whole listings (source_file, path, length)."""
    register(spark)
    reader = spark.readStream.format(NAME).option("what", "files")
    return reader.option("directory", directory).option("pattern", pattern).option("run", run).load()
