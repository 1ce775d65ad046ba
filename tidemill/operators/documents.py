"""JSON event records: files that hold one array of objects.

A documents frame has (source_file, block, chunk, value); every value is the text of one
JSON array. A file of ordinary size is one chunk, a large one is many (see arraysplit).
A file counts only if all of its chunks are strict arrays. A frame may hold the arrays
parsed (items) beside the text, as the raw zone does; then nothing here parses again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import integer_or_null, partition_day
from tidemill.functions.variants import object_fields, strict_array, variant_bigint, variant_flag, variant_text
from tidemill.spec import JSON_RECORD, PREVIEW_CHARS, Field, RecordSpec


def _items(documents: DataFrame) -> Column:
    """The elements of each chunk's array, NULL if it is none."""
    return F.col("items") if "items" in documents.columns else strict_array(F.col("value"))


def parsed(documents: DataFrame) -> DataFrame:
    """Add items: the chunk's array, parsed once for all that comes after."""
    return documents.withColumn("items", strict_array(F.col("value")))


def validate(documents: DataFrame) -> DataFrame:
    """Add is_valid: the chunk is exactly one JSON array."""
    return documents.withColumn("is_valid", _items(documents).isNotNull())


def _objects(items: Column) -> Column:
    # Taken apart inside the array, each element is converted once; a filter after the
    # explode would be pushed below it and convert everything a second time.
    return F.filter(F.transform(items, object_fields), lambda m: m.isNotNull())


def _typed(field: Field, value: Column) -> Column:
    if field.kind == "bigint":
        return variant_bigint(value)
    if field.kind == "flag":
        return variant_flag(value)
    if field.kind == "day":
        return partition_day(variant_text(value))
    return variant_text(value)


def records(documents: DataFrame, spec: RecordSpec = JSON_RECORD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of every object in the valid chunks; nested members come out flat.

    Callers drop files whose other chunks are invalid (block facts know them).
    """
    place = ["source_file", "block", *keep]
    nested = sorted({f.source.split(".")[0] for f in spec.fields if "." in f.source})
    members = documents.select(*place, F.explode(_objects(_items(documents))).alias("members")).select(
        *place,
        "members",
        *[object_fields(F.try_element_at("members", F.lit(n))).alias(f"in_{n}") for n in nested],
    )

    def member(field: Field) -> Column:
        outer, _, inner = field.source.rpartition(".")
        return F.try_element_at(f"in_{outer}" if outer else "members", F.lit(inner)).alias(field.name)

    fields = {f.name: f for f in spec.fields}
    return members.select(*place, *[member(fields[n]) for n in spec.data_columns]).select(
        *place, *[_typed(fields[n], F.col(n)).alias(n) for n in spec.data_columns]
    )


def rejects(documents: DataFrame) -> DataFrame:
    """Array elements that are not objects, with a short preview."""
    others = F.filter(_items(documents), lambda v: object_fields(v).isNull())
    return documents.select("source_file", F.explode(others).alias("element")).select(
        "source_file",
        F.substring(F.coalesce(F.col("element").cast("string"), F.lit("None")), 1, PREVIEW_CHARS).alias("preview"),
        F.lit("not_an_object").alias("reason"),
    )


def block_summary(documents: DataFrame, spec: RecordSpec = JSON_RECORD) -> DataFrame:
    """One row per (file, block): element counts and whether all its chunks are valid."""

    def unreadable(member: Column) -> Column:
        text = F.try_variant_get(member, "$", "string")
        number = F.coalesce(F.try_variant_get(member, "$", "bigint"), integer_or_null(text))
        return text.isNotNull() & number.isNull()

    whole_numbers = [f.source for f in spec.fields if f.kind == "bigint"]

    def failures(members: Column) -> Column:
        hits = [unreadable(F.try_element_at(members, F.lit(s))).cast("int") for s in whole_numbers]
        total = F.lit(0)
        for hit in hits:
            total = total + F.coalesce(hit, F.lit(0))
        return total

    per_chunk = (
        documents.select("source_file", "block", _items(documents).alias("items"))
        .select("*", F.transform("items", object_fields).alias("members"))
        .select(
            "source_file",
            "block",
            F.col("items").isNotNull().alias("is_valid"),
            F.array_size("items").alias("n_items"),
            F.array_size(F.filter("members", lambda m: m.isNotNull())).alias("n_objects"),
            F.aggregate("members", F.lit(0), lambda n, m: n + failures(m)).alias("n_bad_numbers"),
        )
    )

    def total(col: Column) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")

    return per_chunk.groupBy("source_file", "block").agg(
        total(F.col("n_objects")).alias("n_valid"),
        total(F.col("n_items") - F.col("n_objects")).alias("n_reject"),
        total(F.col("n_bad_numbers")).alias("n_cast_failures"),
        F.bool_and("is_valid").alias("is_valid"),
    )
