"""Operator 8: repeated byte strings by a depth-limited radix sort of suffixes.

Every position that starts `length` bytes is a suffix to be ordered through that depth. The passes
go from the most significant digit down and carry on only what shares its digits with another:

1. The first digit of a suffix is the smallest of the hashed 64-byte grams within its depth (the
   rightmost, if tied). Neighbouring suffixes mostly share it, so they go as one run: a few rows per
   hundred bytes instead of one per byte. Equal strings have equal first digits at equal places.
2. The second digit is a run's whole text. Runs equal in both are equal suffix by suffix, however
   many there are of them; a group of copies ends here.
3. Where one first digit has different runs, one of each kind is compared on. With few kinds, each
   pair's common text around the gram says which suffixes they share. With more, the kinds are dealt
   out into suffixes, whose last digit is the string of `length` bytes itself. Both are exact.

Groups of two or more after the last pass are exactly the repeated strings. Digits are compared by
64-bit hashes, two to each group. The first pass keeps what it knows of all runs in Spark; the tasks
of the second get bitmaps of fixed size, and what these let through needlessly falls out by count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import expand, materialize, mixed, prefix_sums, span_hashes, steps, table

LENGTH = 200
GRAM = 64
#: Kinds of runs in one group that are compared pair by pair; larger groups go on as single suffixes.
PAIRED = 24
FILTER_BITS = 26


def _runs(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int):
    """Runs of suffixes with one first digit: row, start, number of suffixes, place of the gram."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    width = length - GRAM + 1
    starts = np.arange(len(data) - GRAM + 1)
    bits = np.uint64(int(len(data)).bit_length())
    # The low bits hold the place, descending: values differ, and of equal grams the last is least.
    key = (span_hashes(sums, starts, starts + GRAM) >> bits << bits) | (len(data) - starts).astype(np.uint64)
    least, span = key, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - span : width - span + len(key) - width + 1])
    gram = len(data) - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(gram)]
    valid = np.arange(len(gram)) + length <= offsets[row + 1]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return none
    ends = np.append(first[1:], len(gram))
    running = np.concatenate([[0], np.cumsum(valid)])
    count = running[ends] - running[first]
    return row[first], first, count, gram[first]


def _digits(sums: np.ndarray, first: np.ndarray, count: np.ndarray, gram: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Both digits of runs: the gram, and the text with the gram's place in it."""
    one = span_hashes(sums, gram, gram + GRAM)
    two = span_hashes(sums, first, first + count + length - 1)
    return one, mixed(two ^ ((gram - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def _first_pass(documents: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches):
            sums = prefix_sums(data)
            _, first, count, gram = _runs(data, offsets, sums, length)
            one, two = _digits(sums, first, count, gram, length)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["one", "two"])

    return documents.select("text").mapInArrow(run, "one long, two int")


def _slots(one: np.ndarray) -> np.ndarray:
    # The low bits: a digit is a smallest hash, so its high bits say little.
    return (one & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def bitmap(digits: DataFrame) -> bytes:
    """Fixed-size bitmap of a column `one`; at most eight partial ones reach the driver, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for part in digits.select("one").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(part.bits, np.uint8)
    return total.tobytes()


def there(bits: bytes, one: np.ndarray) -> np.ndarray:
    slots = _slots(one)
    return (np.frombuffer(bits, np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _second_pass(documents: DataFrame, length: int, shared, mixed_groups) -> DataFrame:
    """Runs whose first digit may be shared; with their text where it may have different runs."""
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            sums = prefix_sums(data)
            row, first, count, gram = _runs(data, offsets, sums, length)
            one, two = _digits(sums, first, count, gram, length)
            keep = np.flatnonzero(there(shared.value, one))
            row, first, count, gram, one, two = (x[keep] for x in (row, first, count, gram, one, two))
            raw, with_text = data.tobytes(), there(mixed_groups.value, one)
            texts = [raw[a:b] if t else None for a, b, t in zip(first.tolist(), (first + count + length - 1).tolist(), with_text.tolist(), strict=True)]
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id").take(index),
                    rows.column("mark").take(index),
                    pa.array(first - offsets[row]),
                    pa.array(count),
                    pa.array(gram - first),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(texts, pa.binary()),
                ],
                ["id", "mark", "first", "count", "gram", "one", "two", "text"],
            )

    return documents.mapInArrow(run, f"id {kind}, mark long, first long, count long, gram long, one long, two long, text binary")


def _common(a: bytes, b: bytes, order: str) -> int:
    """Bytes that two equally long strings share in front (order "big") or at the end ("little")."""
    differing = int.from_bytes(a, order) ^ int.from_bytes(b, order)
    return len(a) - (differing.bit_length() + 7) // 8


def _paired(groups: DataFrame, length: int) -> DataFrame:
    """For (kinds: array of structs) of one first digit: the ranges that single kinds share with another."""
    kind = groups.schema["kinds"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kinds in batch.column("kinds").to_pylist():
                for x in kinds:
                    if x["n"] > 1:
                        continue
                    text, at = x["text"], x["gram"]
                    for y in kinds:
                        if y is x:
                            continue
                        left, right = min(at, y["gram"]), min(len(text) - at, len(y["text"]) - y["gram"])
                        left = _common(text[at - left : at], y["text"][y["gram"] - left : y["gram"]], "little")
                        right = _common(text[at : at + right], y["text"][y["gram"] : y["gram"] + right], "big")
                        if left + right >= length:
                            out.append((x["id"], x["mark"], x["first"] + at - left, x["first"] + at + right))
            if out:
                columns = zip(*out, strict=True)
                types = (batch.schema.field("kinds").type.value_type.field("id").type, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "mark", "start", "end"])

    return groups.select("kinds").mapInArrow(run, f"id {kind}, mark long, start long, end long")


def _third_pass(kinds: DataFrame, length: int) -> DataFrame:
    """Each suffix of runs that are one of a kind in a mixed group: its last digit and place."""
    kind = kinds.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, size=1 << 19):
            sizes = np.diff(offsets) - length + 1
            starts = expand(offsets[:-1], sizes)
            last = span_hashes(prefix_sums(data), starts, starts + length)
            row = np.repeat(np.arange(len(sizes)), sizes)
            index = pa.array(row)
            place = rows.column("first").to_numpy()[row] + starts - offsets[row]
            columns = [rows.column(c).take(index) for c in ("one", "n", "id", "mark")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(last.view(np.int64))], ["one", "n", "id", "mark", "place", "last"])

    return kinds.mapInArrow(run, f"one long, n long, id {kind}, mark long, place long, last long")


def repeated_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, length: int = LENGTH) -> DataFrame:
    """Byte ranges covered by strings of `length` bytes that start elsewhere too: id, mark, start, end.

    Ranges may overlap. Strings do not cross rows; texts that are null, empty or shorter than
    `length` have none. Rows equal in id and text are each other's copies and get the same ranges
    under the same (id, mark); `mark` is the text's hash. Other columns are not read.
    """
    spark = documents.sparkSession
    plain = documents.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("mark"), F.col(text_column).alias("text"))
    groups = _first_pass(plain, length).groupBy("one").agg(F.count("*").alias("n"), F.min("two").alias("low"), F.max("two").alias("high"))
    groups = materialize(groups.where("n > 1").select("one", (F.col("low") != F.col("high")).alias("mixed")), "digits")
    broadcast = spark.sparkContext.broadcast
    shared, mixed_groups = broadcast(bitmap(groups)), broadcast(bitmap(groups.where("mixed")))
    runs = materialize(_second_pass(plain, length, shared, mixed_groups), "runs")

    counted = runs.groupBy("one", "two").agg(F.count("*").alias("n"))
    counted = materialize(counted, "kinds")
    again = counted.where("n > 1").select("one", "two")
    whole = runs.select("id", "mark", "first", "count", "one", "two").join(again, ["one", "two"], "left_semi")
    whole = whole.select("id", "mark", F.col("first").alias("start"), (F.col("first") + F.col("count") + length - 1).alias("end"))

    several = materialize(counted.groupBy("one").agg(F.count("*").alias("k")).where("k > 1"), "several")
    fields = ("id", "mark", "first", "gram", "text")
    # Combined before any shuffle: a run that a third of the documents share is a few rows per task.
    kinds = runs.where("text is not null").groupBy("one", "two").agg(F.count("*").alias("n"), F.first(F.struct(*fields)).alias("x"))
    kinds = materialize(kinds.select("one", "n", "x.*"), "first").join(several, "one")
    kinds = materialize(kinds, "mixed")
    few = kinds.where(F.col("k") <= PAIRED).groupBy("one").agg(F.collect_list(F.struct("n", *fields)).alias("kinds"))
    pairs = _paired(few, length)
    suffixes = materialize(_third_pass(kinds.where(F.col("k") > PAIRED).select("one", "n", "id", "mark", "first", "text"), length), "suffixes")
    found = suffixes.groupBy("one", "last").agg(F.sum("n").alias("total"), F.max(F.when(F.col("n") == 1, 1)).alias("single"))
    found = materialize(found.where("total > 1 and single = 1").select("one", "last"), "repeats")
    parts = suffixes.where("n = 1").join(found, ["one", "last"], "left_semi")
    parts = parts.select("id", "mark", F.col("place").alias("start"), (F.col("place") + length).alias("end"))
    return whole.unionByName(pairs).unionByName(parts)


def remove_spans(documents: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, removed (maximal ranges of bytes, in order) and kept (bytes)."""
    kind = documents.schema[id_column].dataType.simpleString()
    chosen = documents.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("mark"), F.col(text_column).alias("text"))
    by_row = spans.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    by_row = by_row.select(F.col("id").alias("i"), F.col("mark").alias("m"), "cuts")
    joined = chosen.join(by_row, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select("id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            raw = data.tobytes()
            removed, kept = [], []
            for a, b, cuts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("cuts").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for cut in cuts or ():
                    if merged and cut["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], cut["end"])
                    else:
                        merged.append([cut["start"], cut["end"]])
                edges = [0, *(x for m in merged for x in m), b - a]
                kept.append(b"".join(raw[a + s : a + e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": rows.column("id"),
                    "n_bytes": np.diff(offsets),
                    "n_removed": np.diff(offsets) - np.array([len(k) for k in kept], np.int64),
                    "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_column)


def deduplicate_bytes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, length: int = LENGTH) -> DataFrame:
    """All rows without the bytes that strings of `length` bytes cover which stand anywhere else too.

    See repeated_spans for null, empty, short and repeated texts. Judged on the input: where all
    copies of a string are found, all of them go. An empty table gives an empty one.
    """
    return remove_spans(documents, repeated_spans(documents, id_column, text_column, length=length), id_column, text_column)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 200 bytes."""
    return deduplicate_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
