"""Reading VARIANT values the way the JSON record rules ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import integer_or_null

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_array(text: Column) -> Column:
    """ARRAY<VARIANT> of a document that is exactly one JSON array, else NULL.

    The parser ignores text after the first value, so the document is wrapped in an
    object that ends with a seal: with trailing or unbalanced text the seal is lost or a
    further key shows up. The keys come from the text's own hash, which it cannot quote.
    """
    key = F.xxhash64(text).cast("string")
    seal = F.concat(key, F.lit("."))
    wrapped = F.try_parse_json(F.concat(F.lit('{"'), key, F.lit('":'), text, F.lit(',"'), seal, F.lit('":1}')))
    parts = F.try_variant_get(wrapped, "$", "map<string,variant>")

    def root(found: Column) -> Column:
        sealed = found.isNotNull() & (F.size(found) == 2) & F.map_contains_key(found, seal)
        return F.when(sealed, F.try_variant_get(F.try_element_at(found, key), "$", "array<variant>"))

    # One parse for the three looks at it.
    return _let(parts, root)


def object_fields(value: Column) -> Column:
    """MAP of an object's members, NULL for anything that is not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _is_boolean(value: Column, text: Column) -> Column:
    # The type is looked up only for the two texts a boolean can have.
    return text.isin("true", "false") & (F.schema_of_variant(value) == F.lit("BOOLEAN"))


def variant_text(value: Column) -> Column:
    """Missing -> '', JSON null -> 'None', booleans -> 'True'/'False', else the value's text."""

    def by_type(text: Column) -> Column:
        return (
            F.when(_is_boolean(value, text), F.initcap(text))
            .when(text.isNotNull(), text)
            .when(F.is_variant_null(value), F.lit("None"))
            .otherwise(F.lit(""))
        )

    return _let(F.try_variant_get(value, "$", "string"), by_type)


def variant_bigint(value: Column) -> Column:
    """Numbers truncate, true is 1, whole-number text counts; everything else is 0. Commas are not dropped."""
    number = F.try_variant_get(value, "$", "bigint")
    return F.coalesce(number, integer_or_null(F.try_variant_get(value, "$", "string")), F.lit(0).cast("bigint"))


def variant_flag(value: Column) -> Column:
    """'true' only for the JSON literal true."""
    text = F.try_variant_get(value, "$", "string")
    yes = (text == "true") & (F.schema_of_variant(value) == F.lit("BOOLEAN"))
    return F.when(yes, F.lit("true")).otherwise(F.lit("false"))
