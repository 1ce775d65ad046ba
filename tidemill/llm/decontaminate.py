"""Operator 2: benchmark decontamination by winnowing.

Of every six consecutive 5-word hashes the smallest is kept, on both sides, so two texts that share
ten consecutive words keep the same hash at the same place in them. Kept hashes are joined, and each
meeting is extended word by word to the left and right: at ten equal words or more all are marked.
Items of fewer than ten words are looked up whole, by one hash of all their words at every place.

Document hashes pass a bitmap of the benchmark's first. Its size is fixed, whatever the benchmark
holds; a full bitmap lets more rows through to the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import (
    ALPHANUMERIC,
    LOWER,
    expand,
    gram_hashes,
    lists,
    materialize,
    mixed,
    prefix_sums,
    span_hashes,
    steps,
    table,
    word_spans,
)

WINDOW = 10
GRAM = 5
FILTER_BITS = 23

_GRAMS = "array<struct<position:int,short:int,hash:bigint,left:array<string>,right:array<string>>>"
_SCHEMA = f"row long, id {{}}, n_words long, grams {_GRAMS}"


def _winnowed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the kept GRAM-word hashes: the smallest of each window, the rightmost if tied."""
    grams = gram_hashes(hashes, GRAM)
    windows = len(hashes) - WINDOW + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:windows].copy(), np.arange(windows)
    for shift in range(1, WINDOW - GRAM + 1):
        other = grams[shift : shift + windows]
        closer = other <= least
        np.copyto(least, other, where=closer)
        at[closer] = np.flatnonzero(closer) + shift
    kept = np.zeros(len(hashes), bool)
    kept[at[rows[:windows] == rows[WINDOW - 1 :]]] = True
    return np.flatnonzero(kept)


def _short_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    return mixed(gram_hashes(hashes, length) ^ np.uint64(length * 0xA24BAED4963EE407 % (1 << 64)))


def _present(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    slots = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def fingerprints(texts: DataFrame, bits=None, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Per row of (id, text): its words' number and kept hashes with the words around them.

    `lengths`: short lengths looked for at every place; None for the benchmark's own side, where a
    text of fewer than WINDOW words is one gram. `bits`: a broadcast bitmap that hashes must pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bits is None else np.frombuffer(bits.value, np.uint8)
        serial = TaskContext.get().partitionId() << 40
        for batch, data, offsets in steps(batches):
            low = LOWER[data]
            starts, ends, rows = word_spans(low, offsets, ALPHANUMERIC)
            hashes = span_hashes(prefix_sums(low), starts, ends)
            n_words = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
            first = np.cumsum(n_words) - n_words
            places, shorts, values = [], [], []

            def take(at: np.ndarray, short: int, found: np.ndarray) -> None:
                passed = _present(wanted, found)
                places.append(at[passed])
                shorts.append(np.full(int(passed.sum()), short, np.int32))
                values.append(found[passed])

            at = _winnowed(hashes, rows)
            take(at, 0, gram_hashes(hashes, GRAM)[at] if len(at) else np.zeros(0, np.uint64))
            for length in range(1, WINDOW) if lengths is None else lengths:
                found = _short_hashes(hashes, length)
                if lengths is None:
                    at = first[n_words == length]
                else:
                    at = np.flatnonzero(rows[: len(found)] == rows[length - 1 :]) if len(found) else np.zeros(0, np.int64)
                take(at, length, found[at])
            place, short, value = map(np.concatenate, (places, shorts, values))
            order = np.argsort(place, kind="stable")
            place, short, value = place[order], short[order], value[order]
            row = rows[place]
            raw = low.tobytes()

            def words(begin: np.ndarray, counts: np.ndarray, backwards: bool = False) -> pa.Array:
                index = expand(begin, counts)
                if backwards:
                    index = np.repeat(2 * begin + counts - 1, counts) - index
                return lists(pa.array([raw[a:b].decode() for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)], pa.string()), counts)

            before = np.where(short == 0, np.minimum(place - first[row], WINDOW - GRAM), 0)
            after = np.where(short == 0, np.minimum(first[row] + n_words[row] - place, WINDOW), short)
            grams = pa.StructArray.from_arrays(
                [
                    pa.array((place - first[row]).astype(np.int32)),
                    pa.array(short),
                    pa.array(value.view(np.int64)),
                    words(place - before, before, backwards=True),
                    words(place, after),
                ],
                ["position", "short", "hash", "left", "right"],
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(serial + np.arange(batch.num_rows)),
                    "id": batch.column("id"),
                    "n_words": pa.array(n_words),
                    "grams": lists(grams, np.bincount(row, minlength=batch.num_rows)),
                }
            )
            serial += batch.num_rows

    return texts.mapInArrow(run, _SCHEMA.format(texts.schema["id"].dataType.simpleString()))


def _bitmap(hashes: DataFrame) -> bytes:
    """The fixed-size bitmap of a column `hash`; at most eight partial ones reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits[(found & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for part in hashes.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(part.bits, np.uint8)
    return total.tobytes()


def _equal(a: str, b: str) -> str:
    """SQL: how many leading elements two arrays have in common."""
    differs = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return f"if({differs} = 0, size({a}), int({differs}) - 1)"


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_id_column: str = "item_id", item_text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared passages of ten words or more: (rows, marked words, items), keyed by `row`.

    rows: row, id, n_words, one for each row of `documents`, repeated rows and null ids included.
    marked: row, position, one for each word inside an occurrence of a window. items: row, item_id.
    A null or empty text has no words and meets nothing; nor does an item without words. Equal items
    are all reported. Only the columns named are read, so others may have any names.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_id_column).alias("id"), F.col(item_text_column).alias("text"))
    bench = materialize(fingerprints(items), "items")
    exploded = bench.select("id", F.explode("grams").alias("g")).select("id", "g.*")
    lengths = tuple(sorted(r.n_words for r in bench.where(f"n_words > 0 and n_words < {WINDOW}").select("n_words").distinct().collect()))
    bits = spark.sparkContext.broadcast(_bitmap(exploded))
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = materialize(fingerprints(texts, bits, lengths), "fingerprints")

    context = F.sha2(F.concat_ws("|", "hash", "short", F.concat_ws(" ", "left"), F.concat_ws(" ", "right")), 256)
    members = materialize(exploded.select("id", "hash", "short", "left", "right", context.alias("context")).distinct(), "contexts")
    contexts = members.select("hash", "short", "context", F.col("left").alias("l"), F.col("right").alias("r")).dropDuplicates(["context"])
    met = (
        rows.select("row", F.explode("grams").alias("g")).select("row", "g.*")
        .join(materialize(contexts, "contexts"), ["hash", "short"])
        .withColumns({"before": F.expr(_equal("left", "l")), "after": F.expr(_equal("right", "r"))})
    )
    whole = f"after >= if(short = 0, {GRAM}, short) and before + after >= if(short = 0, {WINDOW}, short)"
    hits = materialize(
        met.where(whole).select(
            "row", "context", (F.col("position") - F.col("before")).alias("first"), (F.col("position") + F.col("after") - 1).alias("last")
        ),
        "hits",
    )
    marked = hits.select("row", "first", "last").distinct().select("row", F.explode(F.sequence("first", "last")).alias("position")).distinct()
    found = hits.select("row", "context").distinct().join(members.select("context", F.col("id").alias("item_id")), "context").select("row", "item_id").distinct()
    return rows.select("row", "id", "n_words"), marked, found


def report(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, marked, items = decontaminate(documents, benchmark, id_column, text_column)
    hit = marked.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = items.groupBy("row").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("names")
    )
    return rows.join(hit, "row", "left").join(named, "row", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
