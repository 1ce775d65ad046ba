"""Shared pieces: text as flat byte arrays inside tasks, word positions, hashes, tables on the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import session
from tidemill.session import default_setting, scratch_dir  # noqa: F401  general helpers

#: Text bytes that one numpy step works on. A longer document makes a step of its own.
STEP_BYTES = 1 << 21


#: Text bytes that one Arrow batch brings to a task, unless the session says otherwise.
BATCH_BYTES = "4m"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """session.materialize with small Arrow batches: rows here hold whole texts, in joins two of them."""
    with default_setting(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        return session.materialize(df, purpose)


def release() -> None:
    """Give memory that a task no longer uses back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; its memory is its own affair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, mod `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as its bytes and their offsets by row; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into runs of rows of about `size` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = packed(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
            last = min(last, batch.num_rows, first + 20_000)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last
    release()


def byte_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words: all but the ranges given."""
    out = np.ones(256, bool)
    for low, high in excluded:
        out[low : high + 1] = False
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] and [^\x20\x09-\x0D]; every byte of a longer UTF-8 sequence is a word byte.
ALPHANUMERIC = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
NOT_SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)])


def word_spans(lowered: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end where their row ends."""
    inside = members[lowered]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; span_hashes reads the hash of any span off them."""
    return sums_of(_CODES[data])


def sums_of(codes: np.ndarray) -> np.ndarray:
    """prefix_sums of 64-bit codes, such as the words' hashes, instead of bytes."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * powers(_BASE, len(codes)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive items, regardless of rows; len(hashes) - n + 1 of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for i in range(n):
            total += hashes[i : i + count] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mixed(total + np.uint64(n))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Values dealt out to rows, `counts` to each in turn."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] numbers for each i, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
