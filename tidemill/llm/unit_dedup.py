"""Operator 7: substring dedup by hashed units (lines, or paragraphs between blank lines).

Units are normalised (A-Z in lower case, white space as single spaces, trimmed) and hashed to 128
bits. Of equal units the first in the order (document id, text hash, place) stays; the others are
removed, with their places in the original text kept. Counting combines before the shuffle and is
written out; the join that follows is one Spark can split where one unit has a third of all rows.

Lines differ where the same passage is broken elsewhere or stands inside another line. Its units are
all runs of `words` consecutive words (repeated_passages), found exactly and for a few rows per
hundred words: neighbouring runs mostly share the least hashed gram within them and go as one, and
only where one gram has different surroundings are they dealt out one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, NOT_SPACE, expand, lists, materialize, prefix_sums, span_hashes, steps, sums_of, table, word_spans
from tidemill.llm.repeats import bitmap, there

_BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r\f\v]*\n\\s*")}
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile("[ \t\n\r\f\v]+")


def normalised(unit: str) -> str:
    return _SPACE.sub(" ", unit).strip(" ").translate(_CAPITALS)


def _spans(text: str, unit: str) -> list[tuple[int, int]]:
    """Start and end of the units; a text of n breaks has n + 1."""
    cuts = [(m.start(), m.end()) for m in _BREAKS[unit].finditer(text)]
    return list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True))


def units(documents: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """One row per unit of (id, mark, text) that has `min_words` words or more: id, mark, place, start, end, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in steps(batches):
            raw = data.tobytes()
            out: list[tuple] = []
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                text = raw[a:b].decode()
                for place, (start, end) in enumerate(_spans(text, unit)):
                    plain = normalised(text[start:end])
                    if plain.count(" ") + 1 >= min_words and plain:
                        out.append((k, place, start, end, xxhash.xxh3_128_digest(plain.encode())))
            if out:
                at, place, start, end, digest = zip(*out, strict=True)
                index = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id").take(index), rows.column("mark").take(index), pa.array(place, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())],
                    ["id", "mark", "place", "start", "end", "digest"],
                )

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(run, f"id {kind}, mark long, place int, start int, end int, digest binary")


def _marked(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.withColumn("__mark", F.xxhash64(F.col(text_column))).withColumn("__id", F.col(id_column))


def repeated_units(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, unit: str = "line", min_words: int = 1) -> DataFrame:
    """The units to remove, by document: id, mark, spans array<struct<place, start, end>>, in order.

    Null and empty texts have no units. Rows equal in id and text are one document: a unit that
    stays, stays in each of them. Rows that share an id only are told apart by `mark`, the text's hash.
    """
    plain = _marked(documents.select(id_column, text_column), id_column, text_column)
    plain = plain.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), F.col(text_column).alias("text"))
    found = materialize(units(plain, unit, min_words), "units")
    order = F.struct("id", "mark", "place")
    firsts = found.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last")
    again = found.join(materialize(firsts.select("digest", "first"), "firsts"), "digest")
    gone = again.where(~order.eqNullSafe(F.col("first"))).select("id", "mark", F.struct("place", "start", "end").alias("span"))
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """The names, each with underscores behind it until no column (in any case of letters) has it."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def remove_units(documents: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, unit: str = "line") -> DataFrame:
    """`documents` with the spans' units taken out of the text and two columns added at the end: `n_units`
    and `removed` (the spans). Where a name is taken already, the added column's gets underscores behind it.

    What remains is joined by the unit's break: a line break, or a blank line. A text that loses
    nothing stays as it is; a null text stays null.
    """
    names = documents.columns
    n_units, removed = free_names(["n_units", "removed"], names)
    left, right = _marked(documents, id_column, text_column), spans.select(F.col("id").alias("__i"), F.col("mark").alias("__m"), F.col("spans").alias("__spans"))
    joined = left.join(right, F.col("__id").eqNullSafe(F.col("__i")) & F.col("__mark").eqNullSafe(F.col("__m")), "left")
    glue = {"line": "\n", "paragraph": "\n\n"}[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in steps(batches, text_column):
            raw, texts, counts = data.tobytes(), [], []
            present = rows.column(text_column).is_valid().to_pylist()
            for cut, there, a, b in zip(rows.column(removed).to_pylist(), present, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                text = raw[a:b].decode() if there else None
                kept = _spans(text, unit) if text else []
                counts.append(len(kept))
                if cut:
                    gone = {x["place"] for x in cut}
                    text = glue.join(text[s:e] for k, (s, e) in enumerate(kept) if k not in gone)
                texts.append(text)
            columns = [pa.array(texts, rows.schema.field(c).type) if c == text_column else rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), rows.column(removed)], [*names, n_units, removed])

    cut = F.coalesce("__spans", F.expr("array()")).cast("array<struct<place:int,start:int,end:int>>").alias(removed)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    return joined.select(*names, cut).mapInArrow(run, ", ".join([*fields, f"{n_units} long", f"{removed} array<struct<place:int,start:int,end:int>>"]))


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, unit: str = "line", min_words: int = 1) -> DataFrame:
    """`documents` without their repeated units; see repeated_units and remove_units."""
    spans = materialize(repeated_units(documents, id_column, text_column, unit=unit, min_words=min_words), "repeats")
    return remove_units(documents, spans, id_column, text_column, unit=unit)


#: Words of a passage.
PASSAGE = 50


def _passages(data: np.ndarray, offsets: np.ndarray, words: int):
    """Runs of passages that share their least gram: row, first word in its row, number of passages, gram and text as hashes.

    And the hash of each passage, with where each run's begin among them.
    """
    lowered = LOWER[data]
    starts, ends, row = word_spans(lowered, offsets, NOT_SPACE)
    n = len(starts) - words + 1
    if n <= 0:
        return None
    sums = sums_of(span_hashes(prefix_sums(lowered), starts, ends))
    size = (words + 1) // 2
    at = np.arange(len(starts) - size + 1)
    grams = span_hashes(sums, at, at + size)
    # The low bits hold the place, descending: values differ, and of equal grams the last is least.
    low = np.uint64(0xFFFFFFFF)
    least, span, width = (grams & ~low) | (low - at.astype(np.uint64)), 1, words - size + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[:n], least[width - span : width - span + n])
    gram = (low - (least & low)).astype(np.int64)
    valid = row[:n] == row[words - 1 :]
    new = np.ones(n, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:n] != row[: n - 1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    running = np.concatenate([[0], np.cumsum(valid)])
    count = running[np.append(first[1:], n)] - running[first]
    begins = np.searchsorted(row, np.arange(len(offsets) - 1))
    text = span_hashes(sums, first, first + count + words - 1)
    return row[first], first - begins[row[first]], count, grams[gram[first]], text, span_hashes(sums, at[:n], at[:n] + words), first


def repeated_passages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = PASSAGE) -> DataFrame:
    """The places of passages of `words` words that stand earlier too: id, mark, first, last (words, from 0; `last` excluded).

    Words are compared like units are: A-Z in lower case, white space of any kind between them. Earlier is by
    document id, text hash and place; in the same document, at least `words` words before, so that what is repeated
    at once keeps its first passage. Ranges may overlap. Rows equal in id and text are one document.
    """
    spark = documents.sparkSession
    plain = _marked(documents.select(id_column, text_column), id_column, text_column)
    plain = plain.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), F.col(text_column).alias("text"))
    kind = documents.schema[id_column].dataType.simpleString()

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches):
            if found := _passages(data, offsets, words):
                yield pa.RecordBatch.from_arrays([pa.array(found[3].view(np.int64)), pa.array(found[4].view(np.int64))], ["one", "two"])

    groups = plain.select("text").mapInArrow(digits, "one long, two long").groupBy("one")
    groups = groups.agg(F.count("*").alias("n"), F.min("two").alias("low"), F.max("two").alias("high")).where("n > 1")
    groups = materialize(groups.select("one", (F.col("low") != F.col("high")).alias("mixed")), "passage-digits")
    shared, mixed_groups = spark.sparkContext.broadcast(bitmap(groups)), spark.sparkContext.broadcast(bitmap(groups.where("mixed")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            found = _passages(data, offsets, words)
            if not found:
                continue
            row, first, count, one, two, hashes, at = found
            keep = np.flatnonzero(there(shared.value, one))
            row, first, count, one, two, at = (x[keep] for x in (row, first, count, one, two, at))
            own = np.where(there(mixed_groups.value, one), count, 0)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id").take(index),
                    rows.column("mark").take(index),
                    pa.array(first),
                    pa.array(count),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    lists(pa.array(hashes[expand(at, own)].view(np.int64)), own),
                ],
                ["id", "mark", "first", "count", "one", "two", "hashes"],
            )

    found = materialize(plain.mapInArrow(runs, f"id {kind}, mark long, first long, count long, one long, two long, hashes array<long>"), "passage-runs")
    order = F.struct("id", "mark", "first")
    heads = materialize(found.groupBy("one", "two").agg(F.min(order).alias("head")), "passage-heads")
    several = materialize(heads.groupBy("one").count().where("count > 1").select("one"), "passage-several")
    judged = materialize(found.join(heads, ["one", "two"]).withColumn("gone", _stands_earlier("head", words)), "passage-judged")
    whole = judged.where("gone").select("id", "mark", "first", (F.col("first") + F.col("count") + words - 1).alias("last"))

    # What no equal run has taken out: one by one, where its gram has other surroundings elsewhere.
    rest = judged.where("not gone and size(hashes) > 0").join(several, "one").select("one", "id", "mark", "first", F.posexplode("hashes").alias("place", "hash"))
    rest = materialize(rest.select("one", "hash", "id", "mark", (F.col("first") + F.col("place")).alias("first")), "passage-rest")
    firsts = rest.groupBy("one", "hash").agg(F.min(order).alias("head"), F.max(order).alias("tail")).where("head != tail").drop("tail")
    again = rest.join(materialize(firsts, "passage-firsts"), ["one", "hash"]).where(_stands_earlier("head", words))
    return whole.unionByName(again.select("id", "mark", "first", (F.col("first") + words).alias("last")))


def _stands_earlier(head: str, words: int):
    """Whether `head`, the first of a passage's places, is another document's or no part of this passage."""
    same = F.col(f"{head}.id").eqNullSafe(F.col("id")) & (F.col(f"{head}.mark") == F.col("mark"))
    return ~(same & (F.col("first") - F.col(f"{head}.first") < words))


def remove_passages(documents: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`documents` with the words of repeated_passages' spans taken out of the text, other columns as they are.

    Of the white space before and behind a passage the one with more line breaks stays. A text that
    loses nothing stays as it is; a null text stays null.
    """
    names = documents.columns
    cuts = free_names(["cuts"], names)[0]
    by_row = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("__cuts"))
    left, right = _marked(documents, id_column, text_column), by_row.select(F.col("id").alias("__i"), F.col("mark").alias("__m"), "__cuts")
    joined = left.join(right, F.col("__id").eqNullSafe(F.col("__i")) & F.col("__mark").eqNullSafe(F.col("__m")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, text_column):
            texts, places = rows.column(text_column), rows.column(cuts)
            touched = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                raw, new = data.tobytes(), texts.to_pylist()
                for k in touched.tolist():
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    new[k] = _without(raw[a:b], data[a:b], places[k].as_py()).decode()
                texts = pa.array(new, rows.schema.field(text_column).type)
            yield pa.RecordBatch.from_arrays([texts if c == text_column else rows.column(c) for c in names], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    return joined.select(*names, F.col("__cuts").alias(cuts)).mapInArrow(run, ", ".join(fields))


def _without(raw: bytes, data: np.ndarray, cuts: list[dict]) -> bytes:
    """A text without the words of the cuts."""
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, [c["first"] for c in cuts], 1)
    np.add.at(depth, [c["last"] for c in cuts], -1)
    covered = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    out, at = [], 0
    for first, last in edges.reshape(-1, 2).tolist():
        before = raw[ends[first - 1] : starts[first]] if first else b""
        behind = raw[ends[last - 1] : starts[last]] if last < len(starts) else b""
        out.append(raw[at : ends[first - 1]] if first else b"")
        out.append(max(before, behind, key=lambda s: s.count(b"\n")) if first and last < len(starts) else b"")
        at = int(starts[last]) if last < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


def deduplicate_passages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = PASSAGE) -> DataFrame:
    """`documents` without the passages that stand earlier too; see repeated_passages and remove_passages."""
    spans = materialize(repeated_passages(documents, id_column, text_column, words=words), "passages")
    return remove_passages(documents, spans, id_column, text_column)


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents: characters and lines removed, their places and a digest of what stays."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return deduplicate(documents).select(
        "doc_id",
        sizes.alias("n_removed"),
        F.size("removed").cast("long").alias("lines_removed"),
        F.coalesce(F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ","), F.lit("")).alias("removed_spans"),
        F.col("n_units").alias("lines_seen"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE text IS NOT NULL AND text <> ''),
x AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS line FROM l),
y AS (SELECT *, translate(trim(regexp_replace(line, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM x),
z AS (SELECT *, plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, i) > 1 AS gone FROM y),
k AS (SELECT doc_id, count(*) AS lines_seen, count(*) FILTER (WHERE gone) AS lines_removed,
    coalesce(sum(length(line)) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
    coalesce(string_agg(begins::BIGINT || '-' || (begins + length(line))::BIGINT, ',' ORDER BY i) FILTER (WHERE gone), '') AS removed_spans,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(lines_removed, 0) AS lines_removed, coalesce(lines_seen, 0) AS lines_seen,
  coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
