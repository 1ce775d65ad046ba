"""Cut one huge JSON array into many small ones without reading it in one task.

A file is read in pieces that end at each `}` (the reader splits such a file over many
tasks). What a piece means depends on the text before it in only two ways: whether it
starts inside a string, and how deep. So each piece is read once for either start and
becomes a few numbers, which compose: by prefix sums first inside each block of the file,
then over the per-block totals, a handful of numbers per block.
A piece that brings the depth back to one ends a group of whole elements, and each group
becomes an array of its own. Escapes cannot straddle a cut, as `\\}` is not valid JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.session import materialize, pin_splits


# The parser takes neither longer values nor deeper nesting, so a group beyond either is
# known to be unreadable without being put together.
MAX_GROUP_BYTES = 128 * 1024 * 1024
MAX_DEPTH = 1000


def _piece_order() -> WindowSpec:
    return Window.partitionBy("source_file", "block").orderBy("line_no")


def _up_to_here() -> WindowSpec:
    return _piece_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _block_order() -> WindowSpec:
    return Window.partitionBy("source_file").orderBy("block")


def _count(text: Column, *characters: str) -> Column:
    rest = text
    for character in characters:
        rest = F.replace(rest, F.lit(character), F.lit(""))
    return F.length(text) - F.length(rest)


def _net_depth(text: Column) -> Column:
    """Brackets opened minus closed outside string literals."""
    outside = F.when(text.contains('"'), F.regexp_replace(text, r'"[^"]*("|\z)', "")).otherwise(text)
    return _count(outside, "[", "{") - _count(outside, "]")


def _numbers(pieces: DataFrame, *keep: str) -> DataFrame:
    """What a piece does, by itself: flips (does it end in the other state than it starts in?) and the
    depth change over it and the brace behind it, step_0 if it starts outside strings and step_1 if inside.

    The text is not needed after that: states and depths compose from these numbers.
    """
    escapes = F.regexp_replace("value", r"(?s)\\.", "")
    bare = F.when(F.col("value").contains("\\"), escapes).otherwise(F.col("value"))
    quoted = pieces.withColumn("bare", bare).withColumn("flips", F.pmod(_count(F.col("bare"), '"'), F.lit(2)))
    outside, inside = _net_depth(F.col("bare")), _net_depth(F.concat(F.lit('"'), "bare"))
    return quoted.select(
        "source_file",
        "block",
        "line_no",
        "flips",
        (outside - (F.col("flips") == 0).cast("int")).alias("step_0"),
        (inside - (F.col("flips") == 1).cast("int")).alias("step_1"),
        *keep,
    )


def _states(start: Column) -> tuple[Column, Column]:
    """Whether each piece starts and ends inside a string, in a block that starts in state `start`."""
    ended = F.pmod(F.sum("flips").over(_up_to_here()) + start, F.lit(2))
    return F.pmod(ended + F.col("flips"), F.lit(2)), ended


def _step(started: Column) -> Column:
    return F.when(started == 0, F.col("step_0")).otherwise(F.col("step_1"))


def _with_depths(numbers: DataFrame) -> DataFrame:
    """Running depth of each piece inside its block, for both states the block may start in.

    For s in {0: outside, 1: inside a string}: change_s is the depth change of the piece,
    rel_s the depth behind it relative to the block's start, out_s whether the closing
    brace behind it is structure rather than string content.
    """
    states = [_states(F.lit(s)) for s in (0, 1)]
    return numbers.select(
        "*",
        *[_step(started).alias(f"change_{s}") for s, (started, _) in enumerate(states)],
        *[(ended == 0).alias(f"out_{s}") for s, (_, ended) in enumerate(states)],
    ).select("*", *[F.sum(f"change_{s}").over(_up_to_here()).alias(f"rel_{s}") for s in (0, 1)])


def _block_profiles(pieces: DataFrame) -> DataFrame:
    """Per block: totals and, per start state and relative depth, how many pieces end there."""
    both = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("state"),
                    F.col(f"rel_{s}").alias("rel"),
                    F.col(f"out_{s}").alias("out"),
                    F.col(f"change_{s}").alias("step"),
                )
                for s in (0, 1)
            ]
        )
    )
    place = ["source_file", "block"]
    depths = _with_depths(_numbers(pieces.withColumn("octets", F.octet_length("value") + 1), "octets", "file_size"))
    by_depth = (
        depths.select(*place, "flips", "octets", "file_size", both.alias("h"))
        .groupBy(*place, "h.state", "h.rel")
        .agg(
            F.count_if("h.out").alias("ends"),
            F.sum("h.step").alias("step"),
            F.sum("flips").alias("flips"),
            F.sum("octets").alias("octets"),
            F.max("file_size").alias("file_size"),
        )
    )
    outside = F.col("state") == 0
    return by_depth.groupBy(*place).agg(
        F.sum(F.when(outside, F.col("flips"))).alias("flips"),
        F.sum(F.when(outside, F.col("octets"))).alias("octets"),
        F.sum(F.when(outside, F.col("step")).otherwise(0)).alias("total_0"),
        F.sum(F.when(~outside, F.col("step")).otherwise(0)).alias("total_1"),
        F.collect_list(F.when(F.abs("rel") <= MAX_DEPTH, F.struct("state", "rel", "ends"))).alias("profile"),
        F.max("file_size").alias("file_size"),
    )


def _block_starts(profiles: DataFrame, max_group_bytes: int) -> DataFrame:
    """Per block: string state, depth and number of finished groups at its start."""

    def before(col: str) -> Column:
        return F.coalesce(F.sum(col).over(_block_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    stated = profiles.select("*", F.pmod(before("flips"), F.lit(2)).alias("state")).withColumn(
        "total", F.when(F.col("state") == 0, F.col("total_0")).otherwise(F.col("total_1"))
    )
    deep = stated.select("*", before("total").alias("depth"))
    at_one = F.filter(
        "profile", lambda p: (p["state"] == F.col("state")) & (p["rel"] == 1 - F.col("depth"))
    )
    whole_file = Window.partitionBy("source_file")
    counted = deep.withColumn(
        "groups", F.aggregate(at_one, F.lit(0).cast("bigint"), lambda n, p: n + p["ends"])
    ).withColumn("stretch", F.count_if(F.col("groups") > 0).over(_block_order()))
    # Blocks without an end belong to one group each stretch: is it too long to read?
    unfinished = F.sum(F.when(F.col("groups") == 0, F.col("octets"))).over(
        Window.partitionBy("source_file", "stretch")
    )
    return counted.withColumn("unfinished", F.coalesce(unfinished, F.lit(0))).select(
        "source_file",
        "block",
        "state",
        "depth",
        before("groups").alias("groups_before"),
        F.lead("block").over(_block_order()).isNull().alias("last_block"),
        # Pieces and the braces between them; one byte more means a brace ends the file.
        (F.col("file_size") > F.sum("octets").over(whole_file) - 1).alias("brace_at_end"),
        (F.max("unfinished").over(whole_file) > max_group_bytes).alias("hopeless"),
    )


def _as_array(text: Column, first: Column, closed: Column, brace_at_end: Column) -> Column:
    """A group's text as an array of its own; NULL where the file cannot be one array."""
    body = F.regexp_replace(text, r"^[ \t\r\n]+", "")
    rest = F.regexp_replace(F.substr(body, F.lit(2)), r"^[ \t\r\n]+", "")
    after_comma = body.startswith(",")
    return (
        F.when(closed & first, F.concat(text, F.lit("]")))
        .when(closed & after_comma, F.concat(F.lit("["), rest, F.lit("]")))
        .when(closed | brace_at_end, F.lit(None))
        .when(first, text)
        .when(after_comma & ~rest.startswith("]"), F.concat(F.lit("["), rest))
        .when(body.startswith("]"), F.concat(F.lit("["), body))
    )


def split_arrays(pieces: DataFrame, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """Documents frame of small arrays from a pieces frame.

    `pieces` has (source_file, block, line_no, value, file_size): text between closing
    braces, in reading order. A group gathers one array element and what stands before
    it. A file with a stretch too long to be one (say, whose root is no array) is not
    gathered at all: it comes out as a single unreadable chunk.

    Text crosses one shuffle, by block, where the pieces of each group are put together. Only the
    groups at a block's ends, which may go on in others, are gathered by group after that.
    """
    pin_splits(pieces.sparkSession)
    profiles = materialize(_block_profiles(pieces), "array-blocks")
    starts = _block_starts(profiles, max_group_bytes)
    readable = starts.where(~F.col("hopeless"))
    placed = _numbers(pieces, "value").join(readable, ["source_file", "block"])
    started, ended = _states(F.col("state"))
    stepped = placed.withColumn("step", _step(started)).withColumn("outside", ended == 0)
    depth = F.col("depth") + F.sum("step").over(_up_to_here())
    is_last = F.col("last_block") & F.lead("line_no").over(_piece_order()).isNull()
    ends = stepped.withColumn("ends", (F.col("outside") & (depth == 1) & ~is_last).cast("bigint"))
    grouped = ends.withColumn(
        "chunk", F.col("groups_before") + F.sum("ends").over(_up_to_here()) - F.col("ends")
    )
    facts = [(F.max("ends") == 1).alias("closed"), F.bool_or("brace_at_end").alias("brace_at_end")]
    in_block = grouped.groupBy("source_file", "block", "groups_before", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("pieces"), *facts
    )
    in_block = in_block.withColumn("text", F.array_join(F.transform("pieces", lambda p: p["value"]), "}"))
    complete = F.col("closed") & (F.col("chunk") > F.col("groups_before"))
    columns = ["source_file", "block", "chunk", "text", "closed", "brace_at_end"]
    across = (
        in_block.where(~complete)
        .groupBy("source_file", "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"),
            F.bool_or("closed").alias("closed"),
            F.bool_or("brace_at_end").alias("brace_at_end"),
        )
        .withColumn("block", F.col("parts")[0]["block"])
        .withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "}"))
    )
    whole = in_block.where(complete).select(*columns).unionByName(across.select(*columns))
    text = F.when(F.col("closed"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    chunks = whole.select(
        "source_file",
        "block",
        "chunk",
        _as_array(text, F.col("chunk") == 0, F.col("closed"), F.col("brace_at_end")).alias("value"),
    )
    first_block = F.lit(0).cast("bigint")
    unreadable = starts.where("hopeless").select(
        "source_file", first_block.alias("block"), first_block.alias("chunk"), F.lit(None).cast("string").alias("value")
    )
    return chunks.unionByName(unreadable.distinct())
