"""Declarative record layouts: one source for parsing, table schemas and DDL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the file formats.
HEADER_MARKER = "##INGEST_METADATA##"
HEADER_TS_KEY = "ingest_ts="
SEGMENT_SEPARATOR = " | "
PAIR_SEPARATOR = ": "
LEDGER_SEPARATOR = "|"
UNKNOWN_TS = "unknown"
NO_DATE = "1900-01-01"
PREVIEW_CHARS = 80
TEXT_PATTERN = "*.txt"
JSON_PATTERN = "*.json"

LINEAGE = ("source_file", "ingest_ts", "processing_ts")


@dataclass(frozen=True)
class Field:
    """One output column: `source` is a label or a dotted JSON path."""

    name: str
    source: str
    kind: str = "text"  # text | bigint | day | flag


@dataclass(frozen=True)
class RecordSpec:
    """Ordered fields of a record; the `day` field partitions the table."""

    fields: tuple[Field, ...]
    required: str = ""  # label that must be present as a pair (labelled text only)

    @property
    def partition(self) -> Field:
        return next(f for f in self.fields if f.kind == "day")

    @property
    def values(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.kind != "day")

    @property
    def data_columns(self) -> list[str]:
        """Columns read from the record itself, partition last."""
        return [f.name for f in self.values] + [self.partition.name]

    @property
    def columns(self) -> list[str]:
        """Table columns: values, lineage, partition."""
        return [f.name for f in self.values] + list(LINEAGE) + [self.partition.name]

    @property
    def schema(self) -> StructType:
        kinds = {f.name: f.kind for f in self.fields}
        return StructType(
            [StructField(c, LongType() if kinds.get(c) == "bigint" else StringType(), True) for c in self.columns]
        )


# Labels and JSON keys: fixed values of the two record formats, in table order.
TEXT_RECORD = RecordSpec(
    required="Event ID",
    fields=(
        Field("event_id", "Event ID"),
        Field("event_name", "Event Name"),
        Field("sport_type", "Sport"),
        Field("venue", "Venue"),
        Field("city", "City"),
        Field("country", "Country"),
        Field("team_a", "Team A"),
        Field("team_b", "Team B"),
        Field("status", "Status"),
        Field("attendance", "Attendance", "bigint"),
        Field("event_date", "Event Date", "day"),
    ),
)

JSON_RECORD = RecordSpec(
    fields=(
        Field("event_id", "event_id"),
        Field("event_name", "event_name"),
        Field("sport_type", "sport"),
        Field("venue", "venue"),
        Field("city", "city"),
        Field("country", "country"),
        Field("team_a", "team_a"),
        Field("team_b", "team_b"),
        Field("status", "status"),
        Field("attendance", "attendance", "bigint"),
        Field("meta_source_system", "metadata.source_system"),
        Field("meta_priority", "metadata.priority"),
        Field("meta_broadcast", "metadata.broadcast", "flag"),
        Field("meta_category", "metadata.category"),
        Field("meta_referee", "metadata.referee"),
        Field("meta_notes", "metadata.notes"),
        Field("event_date", "event_date", "day"),
    ),
)
