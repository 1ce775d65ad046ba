"""Synthetic event rows, as labelled lines or JSON documents, from a column of ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draws import Draws, pick
from tidemill.spec import JSON_RECORD, PAIR_SEPARATOR, SEGMENT_SEPARATOR, TEXT_RECORD

# The vocabulary and ranges the reports are asked about.
SPORT_WEIGHTS = {"Football": 5, "Athletics": 1, "Swimming": 1, "Basketball": 1, "Handball": 1, "Volleyball": 1}
VENUE_CITIES = {
    "Lusail Stadium": "Lusail",
    "Education City Stadium": "Al Rayyan",
    "Al Bayt Stadium": "Al Khor",
    "Khalifa International Stadium": "Doha",
    "Ahmad Bin Ali Stadium": "Al Rayyan",
    "Al Janoub Stadium": "Al Wakrah",
    "Al Thumama Stadium": "Doha",
    "Aspire Zone Arena": "Doha",
    "Qatar Sports Club Arena": "Doha",
    "Al Wakrah Sports Complex": "Al Wakrah",
}
STATUSES = ("Scheduled", "Confirmed", "Postponed", "Cancelled", "Completed", "In Progress")
PRIORITIES = ("High", "Medium", "Low")
CATEGORIES = ("International", "Domestic", "Friendly", "Tournament", "Training")
COUNTRY = "Qatar"
EVENT_NUMBERS = (1000, 9999)
ATTENDANCE = (5000, 88000)
DAYS = (-5, 45)


def _numbered(stem: str, count: int) -> tuple[str, ...]:
    return tuple(f"{stem} {n}" for n in range(1, count + 1))


@dataclass(frozen=True)
class Pools:
    """Names the rows are drawn from; replace any of them."""

    event_names: tuple[str, ...] = _numbered("Cup Match", 28)
    teams: tuple[str, ...] = _numbered("Club", 18)
    source_systems: tuple[str, ...] = _numbered("Feed", 4)
    referees: tuple[str, ...] = _numbered("Referee", 6)
    notes: tuple[str, ...] = _numbered("Remark", 10)
    venue_cities: dict[str, str] = field(default_factory=lambda: dict(VENUE_CITIES))


def city_of(venue: Column, venue_cities: dict[str, str]) -> Column:
    """The city of a venue, from a small fixed table."""
    pairs = [F.lit(x) for pair in venue_cities.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), venue)


def rows(ids: DataFrame, key: str, as_of: Column, seed: int = 7, pools: Pools = Pools()) -> DataFrame:
    """One event per id: `key` plus every column of the JSON record, nothing else."""
    draw = Draws(F.col(key), seed)
    sports = [sport for sport, weight in SPORT_WEIGHTS.items() for _ in range(weight)]
    teams = len(pools.teams)
    first = F.pmod(draw.integer(5), F.lit(teams))
    # An offset of 1 to n-1 from the first team: never the same team twice.
    second = F.pmod(first + 1 + F.pmod(draw.integer(6), F.lit(teams - 1)), F.lit(teams))
    day = F.date_add(as_of, draw.between(4, *DAYS).cast("int"))
    return (
        ids.select(key)
        .withColumn("event_id", F.concat(F.lit("EVT"), draw.between(0, *EVENT_NUMBERS).cast("string")))
        .withColumn("event_name", draw.choice(1, pools.event_names))
        .withColumn("sport_type", draw.choice(2, sports))
        .withColumn("venue", draw.choice(3, list(pools.venue_cities)))
        .withColumn("city", city_of(F.col("venue"), pools.venue_cities))
        .withColumn("country", F.lit(COUNTRY))
        .withColumn("team_a", pick(pools.teams, first))
        .withColumn("team_b", pick(pools.teams, second))
        .withColumn("status", draw.choice(7, STATUSES))
        .withColumn("attendance", draw.between(8, *ATTENDANCE))
        .withColumn("meta_source_system", draw.choice(9, pools.source_systems))
        .withColumn("meta_priority", draw.choice(10, PRIORITIES))
        .withColumn("meta_broadcast", draw.choice(11, ("true", "false")))
        .withColumn("meta_category", draw.choice(12, CATEGORIES))
        .withColumn("meta_referee", draw.choice(13, pools.referees))
        .withColumn("meta_notes", draw.choice(14, pools.notes))
        .withColumn("event_date", F.date_format(day, "yyyy-MM-dd"))
    )


def labelled_line() -> Column:
    """A row of `rows` as one labelled line, labels in the order of the format."""
    sources = {f.name: f.source for f in TEXT_RECORD.fields}
    order = [f.name for f in TEXT_RECORD.fields if f.kind != "day"]
    order.insert(order.index("team_a"), TEXT_RECORD.partition.name)
    parts = [F.concat(F.lit(sources[n] + PAIR_SEPARATOR), F.col(n).cast("string")) for n in order]
    return F.concat_ws(SEGMENT_SEPARATOR, *parts)


def json_object() -> Column:
    """A row of `rows` as one JSON object with its nested members."""
    flat = [F.col(f.name).alias(f.source) for f in JSON_RECORD.fields if "." not in f.source]
    nested: dict[str, list[Column]] = {}
    for f in JSON_RECORD.fields:
        outer, _, inner = f.source.rpartition(".")
        if outer:
            value = F.col(f.name) == "true" if f.kind == "flag" else F.col(f.name)
            nested.setdefault(outer, []).append(value.alias(inner))
    return F.to_json(F.struct(*flat, *[F.struct(*members).alias(o) for o, members in nested.items()]))


def json_documents(objects: DataFrame, key: str, per_file: int) -> DataFrame:
    """Documents frame of arrays from (key, value): `per_file` consecutive keys each.

    Keys are unique whole numbers, so a document gathers at most `per_file` objects.
    """
    file_no = F.floor(F.col(key) / per_file)
    ordered = F.array_sort(F.collect_list(F.struct(key, "value")))
    return (
        objects.groupBy(file_no.alias("file_no"))
        .agg(F.array_join(F.transform(ordered, lambda o: o["value"]), ",\n").alias("body"))
        .select(
            F.format_string("events_%08d.json", "file_no").alias("source_file"),
            F.lit(0).cast("bigint").alias("block"),
            F.lit(0).cast("bigint").alias("chunk"),
            F.concat(F.lit("[\n"), "body", F.lit("\n]")).alias("value"),
        )
    )
