"""Labelled text records: `Label: value | Label: value`, one per line.

A lines frame has (source_file, block, line_no, value): `block` numbers the pieces a
file was read in and `line_no` orders the lines of a piece. Files of any size spread
over many blocks, so nothing below ever gathers a whole file in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import (
    after,
    has_only_spaces,
    integer_or_null,
    lenient_bigint,
    partition_day,
    strip,
    strip_within,
)
from tidemill.spec import (
    HEADER_MARKER,
    HEADER_TS_KEY,
    PAIR_SEPARATOR,
    PREVIEW_CHARS,
    SEGMENT_SEPARATOR,
    TEXT_RECORD,
    Field,
    RecordSpec,
)


def classify(lines: DataFrame, spec: RecordSpec = TEXT_RECORD) -> DataFrame:
    """Add only_spaces, body, segments, labels and kind (blank, header, record, reject).

    Segments are kept last-first, so the first hit for a label is the pair that wins.
    """
    # A line holds no line break, and splitting at one character needs no regex.
    cut = F.split(F.replace("body", F.lit(SEGMENT_SEPARATOR), F.lit("\n")), "\n", -1)

    def labels(trim: Callable[[Column], Column]) -> Column:
        return F.transform(
            "segments",
            lambda s: F.when(s.contains(PAIR_SEPARATOR), trim(F.substring_index(s, PAIR_SEPARATOR, 1))),
        )

    body = F.col("body")
    is_record = body.contains(spec.required + ":") & (F.array_position("labels", F.lit(spec.required)) > 0)
    return (
        lines.withColumn("only_spaces", has_only_spaces(F.col("value")))
        .withColumn("body", strip_within(F.col("value"), F.col("only_spaces")))
        .withColumn("segments", F.reverse(cut))
        .withColumn("labels", F.when(F.col("only_spaces"), labels(F.trim)).otherwise(labels(strip)))
        .withColumn(
            "kind",
            F.when(body == "", "blank")
            .when(body.startswith(HEADER_MARKER), "header")
            .when(is_record, "record")
            .otherwise("reject"),
        )
    )


def _raw(field: Field) -> Column:
    """Stripped value behind a label, NULL where the label does not occur."""
    position = F.array_position("labels", F.lit(field.source)).cast("int")
    return strip_within(after(F.get("segments", position - 1), PAIR_SEPARATOR), F.col("only_spaces"))


def _typed(field: Field, raw: Column) -> Column:
    if field.kind == "bigint":
        return lenient_bigint(raw)
    if field.kind == "day":
        return partition_day(raw)
    return F.coalesce(raw, F.lit(""))


def records(classified: DataFrame, spec: RecordSpec = TEXT_RECORD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of the accepted lines, in record order, with the place they came from."""
    fields = {f.name: f for f in spec.fields}
    place = ["source_file", "block", *keep]
    # As a generator rather than a filter: a filter would move below the labels and
    # work them out a second time for every line.
    accepted = F.when(F.col("kind") == "record", F.array(F.struct("only_spaces", "segments", "labels")))
    found = classified.select(*place, F.inline(accepted)).select(
        *place, *[_raw(fields[name]).alias(name) for name in spec.data_columns]
    )
    return found.select(
        *place, *[_typed(fields[name], F.col(name)).alias(name) for name in spec.data_columns]
    )


def rejects(classified: DataFrame, spec: RecordSpec = TEXT_RECORD) -> DataFrame:
    """Lines that are neither blank nor header nor record, with a short preview and the reason."""
    return classified.where(F.col("kind") == "reject").select("source_file", *_refusal(spec))


def _refusal(spec: RecordSpec) -> list[Column]:
    reason = F.when(F.col("body").contains(spec.required + ":"), "no_required_pair").otherwise("no_marker")
    return [F.substring("body", 1, PREVIEW_CHARS).alias("preview"), reason.alias("reason")]


def with_header_lines(lines: DataFrame, files: DataFrame, ingest_ts: str | Column) -> DataFrame:
    """Put one lineage header line in front of every file in `files` (source_file)."""
    ts = F.lit(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    header = files.select(
        "source_file",
        F.lit(-1).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(
            F.lit(HEADER_MARKER + " source_file="), F.col("source_file"), F.lit(" " + HEADER_TS_KEY), ts
        ).alias("value"),
    )
    return header.unionByName(lines.select(header.columns))


def block_headers(lines: DataFrame) -> DataFrame:
    """One row per (file, block) with the first header timestamp in it; the lines are not taken apart.

    For uses that need the timestamps and no counts. A line is looked into only where it holds both
    marks of a header, and stripping one that does is all there is to parse. Same groupings as
    `block_summary`, so equal timestamps.
    """
    marked = F.col("value").contains(HEADER_MARKER) & F.col("value").contains(HEADER_TS_KEY)
    stamp = F.when(
        marked & strip(F.col("value")).startswith(HEADER_MARKER), strip(after(F.col("value"), HEADER_TS_KEY))
    )
    per_header = (
        lines.select("source_file", "block", "line_no", stamp.alias("header_ts"))
        .groupBy("source_file", "block", "header_ts")
        .agg(F.min("line_no").alias("first_line"))
    )
    return per_header.groupBy("source_file", "block").agg(_first_header())


def _first_header() -> Column:
    first = F.min(F.when(F.col("header_ts").isNotNull(), F.struct("first_line", "header_ts")))
    return first["header_ts"].alias("header_ts")


def block_summary(classified: DataFrame, spec: RecordSpec = TEXT_RECORD) -> DataFrame:
    """One row per (file, block): counts by kind and the first header timestamp in it.

    One pass over the text. The wide first grouping has fixed-width buffers only, so it
    hash-aggregates on the map side; the string-valued minimum sees just its few rows.
    """
    unreadable = F.lit(False)
    for field in spec.fields:
        if field.kind == "bigint":
            unreadable = unreadable | _unreadable(_raw(field))
    return _by_block(classified.withColumn("header_ts", _header_ts()).withColumn("unreadable", unreadable))


def _header_ts() -> Column:
    is_header = (F.col("kind") == "header") & F.col("value").contains(HEADER_TS_KEY)
    return F.when(is_header, strip(after(F.col("value"), HEADER_TS_KEY)))


def _unreadable(raw: Column) -> Column:
    text = F.replace(raw, F.lit(","), F.lit(""))
    return F.coalesce(text.isNotNull() & integer_or_null(text).isNull(), F.lit(False))


def _by_block(lines: DataFrame) -> DataFrame:
    per_header = lines.groupBy("source_file", "block", "header_ts").agg(
        F.count_if(F.col("kind") == "record").alias("n_valid"),
        F.count_if(F.col("kind") == "reject").alias("n_reject"),
        F.count_if((F.col("kind") == "record") & F.col("unreadable")).alias("n_cast_failures"),
        F.min("line_no").alias("first_line"),
    )
    return per_header.groupBy("source_file", "block").agg(
        F.sum("n_valid").alias("n_valid"),
        F.sum("n_reject").alias("n_reject"),
        F.sum("n_cast_failures").alias("n_cast_failures"),
        _first_header(),
    )


def parsed(lines: DataFrame, spec: RecordSpec = TEXT_RECORD) -> DataFrame:
    """All that a load asks of a line, worked out once: kind, header_ts, unreadable (has a number that is
    none), preview and reason of a reject, and the typed columns, which mean something for records only.

    A load writes this down and takes counts, rows and rejects from it; see parsed_summary,
    parsed_records and parsed_rejects, which give what block_summary, records and rejects give.
    """
    fields = {f.name: f for f in spec.fields}
    facts = ["source_file", "block", "line_no", "kind", "header_ts", "preview", "reason"]
    refusal = [F.when(F.col("kind") == "reject", c).alias(n) for c, n in zip(_refusal(spec), ("preview", "reason"), strict=True)]
    # A generator, as in `records`, so that nothing above it is worked out a second time.
    line = F.struct("kind", _header_ts().alias("header_ts"), *refusal, "only_spaces", "segments", "labels")
    found = classify(lines, spec).select("source_file", "block", "line_no", F.inline(F.array(line))).select(
        *facts, *[_raw(fields[name]).alias(name) for name in spec.data_columns]
    )
    unreadable = F.lit(False)
    for name in spec.data_columns:
        if fields[name].kind == "bigint":
            unreadable = unreadable | _unreadable(F.col(name))
    return found.select(*facts, unreadable.alias("unreadable"), *[_typed(fields[name], F.col(name)).alias(name) for name in spec.data_columns])


def parsed_summary(lines: DataFrame) -> DataFrame:
    """`block_summary` of a parsed frame."""
    return _by_block(lines)


def parsed_records(lines: DataFrame, spec: RecordSpec = TEXT_RECORD, keep: tuple[str, ...] = ()) -> DataFrame:
    """`records` of a parsed frame."""
    return lines.where(F.col("kind") == "record").select("source_file", "block", *keep, *spec.data_columns)


def parsed_rejects(lines: DataFrame) -> DataFrame:
    """`rejects` of a parsed frame."""
    return lines.where(F.col("kind") == "reject").select("source_file", "preview", "reason")
