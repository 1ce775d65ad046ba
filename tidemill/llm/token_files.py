"""Operator 6: token ids as flat binary files with document offsets.

A shard holds the documents of one range of ids: `<name>.ids` with unsigned integers one after the
other, `<name>.idx` with 64-bit integers, document ids first, then the offsets of their first ids
and the end. Shards are written by the tasks that encode them, straight to the shared folder under
names of their own, so an attempt that dies leaves a file no manifest names. The manifest, a Parquet
table of one row per shard, gets the shards' bases from prefix sums over their counts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe import encoder
from tidemill.llm.common import scratch_dir, steps, table

#: Bytes of text that make one shard, about; smaller tables make a shard per core, down to LEAST_BYTES each.
SHARD_BYTES = 1 << 27
LEAST_BYTES = 1 << 22
#: Ids that a reader holds at a time.
RANGE_IDS = 1 << 21


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def shard_count(documents: DataFrame, text_column: str) -> int:
    """How many shards the bytes of all texts make."""
    size = documents.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    small = min(-(-size // LEAST_BYTES), 2 * documents.sparkSession.sparkContext.defaultParallelism)
    return max(1, small, -(-size // SHARD_BYTES))


def write_token_files(documents: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", *,
                      path: str | None = None, pattern: str = public_tokenizers.PATTERN, end_id: int = 0,
                      dtype: str = "<u2", shards: int | None = None) -> DataFrame:
    """Encode, append `end_id` to each document and write shards in ascending id order; returns the manifest.

    A null text is empty, so its document is the end id alone. Rows without an id come first, under
    the smallest 64-bit number; repeated rows are written each. Ids beyond `dtype` raise an error. An
    empty table has no shards. `folder` must be one that all executors reach.
    """
    spark = documents.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    shards = shards or shard_count(documents, text_column)
    limit = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoder(path, pattern), TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        store, root = _store(folder)
        keys, lengths, file = [], [], None
        end = np.array([end_id], np.dtype(dtype)).tobytes()
        try:
            for rows, data, ends in steps(batches):
                raw = data.tobytes()
                found = own.encode([raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                if max((int(x.max()) for x in found if len(x)), default=0) > limit:
                    raise ValueError(f"a token id exceeds {dtype}")
                file = file or store.open_output_stream(f"{root}/{name}.ids")
                file.write(b"".join(part for x in found for part in (x.astype(dtype).tobytes(), end)))
                keys.append(rows.column("id").to_numpy(zero_copy_only=False))
                lengths.append(np.array([len(x) + 1 for x in found], np.int64))
        finally:
            if file:
                file.close()
        if not keys:
            return
        ids, counts = np.concatenate(keys).astype("<i8"), np.concatenate(lengths)
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(ids.tobytes() + np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [number], "name": [name], "n_documents": [len(ids)], "n_ids": [int(counts.sum())]},
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())]),
        )

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    smallest = F.lit(-(1 << 63)).cast("long")
    ordered = (
        documents.select(F.coalesce(F.col(id_column).cast("long"), smallest).alias("id"), F.col(text_column).alias("text"))
        .repartitionByRange(shards, "id")
        .sortWithinPartitions("id")
    )
    counted = ordered.mapInArrow(run, "shard int, name string, n_documents long, n_ids long")
    counted.write.parquet(f"{folder}/counts")
    # One row per shard: the running sum is over the shards, not over documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = spark.read.parquet(f"{folder}/counts")
    based = counts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    based.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class _Integers:
    """A file of integers, read by ranges: mapped to memory on a mounted folder, else fetched from its store."""

    def __init__(self, folder: str, name: str, dtype: str):
        store, root = _store(folder)
        self.dtype, self.file = np.dtype(dtype), None
        if isinstance(store, pafs.LocalFileSystem):
            self.mapped = np.memmap(f"{root}/{name}", dtype, "r")
        else:
            self.file = store.open_input_file(f"{root}/{name}")

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return np.array(self.mapped[at])
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.dtype)


def read_token_files(manifest: DataFrame, folder: str, dtype: str = "<u2", *, ids: bool = False) -> DataFrame:
    """The documents of all shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, their ids as array."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, tokens = row["n_documents"], _Integers(folder, f"{row['name']}.ids", dtype)
                index = _Integers(folder, f"{row['name']}.idx", "<i8")
                first = 0
                while first < n:
                    # As many documents as a range of ids holds; a longer document is a range of its own.
                    last = min(n, first + 10_000)
                    cuts = index[n + first : n + last + 1]
                    last = first + max(1, int(np.searchsorted(cuts, cuts[0] + RANGE_IDS, "right")) - 1)
                    cuts = cuts[: last - first + 1]
                    held = tokens[int(cuts[0]) : int(cuts[-1])].astype("<u4")
                    parts = [held[a:b] for a, b in zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0], strict=True)]
                    out = {
                        "doc_id": index[first:last],
                        "start": row["base"] + cuts[:-1],
                        "n_tokens": np.diff(cuts),
                        "ids_crc32": np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64),
                    }
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([p.astype(np.int64) for p in parts])} if ids else {}))
                    first = last

    # One manifest row is the work of a task, up to a number of tasks that Spark's driver can follow.
    spread = manifest.repartition(min(max(1, manifest.count()), 50_000), "shard")
    return spread.mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, then read back."""
    folder = scratch_dir(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
