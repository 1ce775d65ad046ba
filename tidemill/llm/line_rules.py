"""Operator 12: line-first cleaning. Rules judge single lines; a document that loses too many words to them goes.

Each step of a task works on the words of many documents at once: counts per line come from running
sums over the step's bytes, and only exact word equality goes through a dictionary. Nothing is
shuffled. A line has one verdict, the first of these rules that it breaks:

* navigation: two or more words are separators only, and these are a fifth of the words or more
* symbols: of three words or more, over three tenths hold one of `#*$%&|<>`
* shouting: of three words or more, over half have two capitals A-Z or more and no small letter a-z
* repetition: of four words or more, over half equal the word before them in the line
* boilerplate: at most 30 words, with one of PHRASES in them
* punctuation: the last word doesn't end in one of ENDS

Lines without a word have no verdict and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, NOT_SPACE, lists, steps, table, word_spans

RULES = ("navigation", "symbols", "shouting", "repetition", "boilerplate", "punctuation")
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "·", "»", "›", "•")
ENDS = (".", "!", "?", '"', "'", ":", ";", ")", "”", "’", "…", "»", "。", "！", "？")
PHRASES = (
    "all rights reserved",
    "cookie",
    "copyright (c)",
    "enable javascript",
    "licensed under the",
    "log in to",
    "privacy policy",
    "released under the",
    "sign up for",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
PHRASE_WORDS = 30
#: A document goes if the lines removed hold more than this share of its words, in hundredths.
MOST_LOST = 40
LEAST_WORDS, MOST_REPEATED = 50, 50

_NEWLINE = ord("\n")
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_SPAN = "array<struct<line:int,start:int,end:int,rule:string>>"
SCHEMA = (
    "text string, removed " + _SPAN + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_words_removed long, base_failed boolean, kept boolean"
)


def _among(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


_SYMBOL = _among(SYMBOLS)
_UPPER, _LOWER = _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("abcdefghijklmnopqrstuvwxyz")


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


@dataclass(frozen=True)
class Lines:
    """The \\n-split lines of a step's rows, in order; an empty text is one empty line."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, and one more
    breaks: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Lines:
        breaks = np.flatnonzero(data == _NEWLINE)
        n = len(offsets) - 1
        row_of_break = np.searchsorted(offsets, breaks, "right") - 1
        at = np.arange(len(breaks))
        first = np.searchsorted(breaks, offsets) + np.arange(n + 1)
        start, end = np.empty(n + len(breaks), np.int64), np.empty(n + len(breaks), np.int64)
        start[first[:-1]], start[row_of_break + at + 1] = offsets[:-1], breaks + 1
        end[first[1:] - 1], end[row_of_break + at] = offsets[1:], breaks
        return cls(start, end, np.repeat(np.arange(n), np.diff(first)), first, breaks)


def _word_ids(raw: bytes, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers that are equal just for equal words of one row."""
    out, known, now = np.empty(len(starts), np.int64), {}, -1
    for k, (a, b, row) in enumerate(zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True)):
        if row != now:
            base, known, now = (k, {}, row)
        out[k] = base + known.setdefault(raw[a:b], len(known))
    return out


def _repeated(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words stand in a window of three words that its row has twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return out
    # Ids differ between rows, so windows of different rows never meet; windows across rows don't count.
    whole = rows[:-2] == rows[2:]
    _, pair = np.unique(ids[:-2] * len(ids) + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(pair * len(ids) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(whole & (times[window] > 1))
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def _ends_well(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Whether the text up to each end closes with one of ENDS."""
    marks = tuple(mark.encode() for mark in ENDS)
    return np.array([raw.endswith(marks, max(0, end - 4), end) for end in ends.tolist()], bool)


def _separators(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    for mark in SEPARATORS:
        code = mark.encode()
        at = np.flatnonzero(ends - starts == len(code))
        for i, byte in enumerate(code):
            at = at[data[starts[at] + i] == byte]
        out[at] = True
    return out


def verdicts(raw: bytes, data: np.ndarray, lines: Lines, starts: np.ndarray, ends: np.ndarray, line: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The index in RULES of the rule each line breaks first, or -1. `line`: of each word."""
    n = len(lines.start)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line[flags], minlength=n)

    def held(characters: np.ndarray) -> np.ndarray:
        sums = _running(characters[data])
        return sums[ends] - sums[starts]

    words = np.bincount(line, minlength=n)
    separators, symbols = count(_separators(data, starts, ends)), count(held(_SYMBOL) > 0)
    shouted = count((held(_UPPER) >= 2) & (held(_LOWER) == 0))
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])
    phrased = np.zeros(n, bool)
    for m in _PHRASES.finditer(LOWER[data].tobytes()):
        k = int(np.searchsorted(lines.start, m.start(), "right")) - 1
        phrased[k] |= m.end() <= lines.end[k]  # else it runs into the next row
    last = np.searchsorted(line, np.arange(n), "right") - 1
    well = np.zeros(n, bool)
    filled = words > 0
    well[filled] = _ends_well(raw, ends[last[filled]])
    broken = (
        (separators >= 2) & (100 * separators >= 20 * words),
        (words >= 3) & (100 * symbols > 30 * words),
        (words >= 3) & (2 * shouted > words),
        (words >= 4) & (2 * count(same) > words),
        (words <= PHRASE_WORDS) & phrased,
        ~well,
    )
    out = np.full(n, -1)
    for rule in reversed(range(len(RULES))):
        out[broken[rule] & filled] = rule
    return out


def clean(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, removed, counts, base_failed, kept) of each row, in SCHEMA's columns.

    `text` is what the line rules leave, its lines joined as before; null stays null. `removed` has the
    line's number from 0, its bytes in the original UTF-8 text and the rule. Null and empty texts have
    no words, fail the base and are not kept. Rows are judged one by one: null or repeated ids and
    equal rows do no harm. Other columns are not read, so their names can't clash.
    """
    plain = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            raw, n = data.tobytes(), rows.num_rows
            lines = Lines.of(data, offsets)
            starts, ends, row = word_spans(data, offsets, NOT_SPACE)
            line = row + np.searchsorted(lines.breaks, starts)
            ids = _word_ids(raw, starts, ends, row)
            rule = verdicts(raw, data, lines, starts, ends, line, ids)
            words = np.bincount(row, minlength=n)
            lost = np.bincount(row[rule[line] >= 0], minlength=n)
            repeated = np.bincount(row[_repeated(ids, row)], minlength=n)
            inside = _running(NOT_SPACE[data] & ((data & 0xC0) != 0x80))  # first bytes of characters in words
            symbols = _running(_SYMBOL[data])
            with_word = np.bincount(line, minlength=len(lines.start)) > 0
            twice, seen, now = np.zeros(n, np.int64), set(), -1
            for k in np.flatnonzero(with_word).tolist():
                if lines.row[k] != now:
                    now, seen = lines.row[k], set()
                value = raw[lines.start[k] : lines.end[k]]
                twice[now] += value in seen
                seen.add(value)
            gone = np.flatnonzero(rule >= 0)
            texts = rows.column("text").to_pylist()
            for r in np.unique(lines.row[gone]).tolist():
                stay = [k for k in range(lines.first[r], lines.first[r + 1]) if rule[k] < 0]
                texts[r] = b"\n".join(raw[lines.start[k] : lines.end[k]] for k in stay).decode()
            at = lines.row[gone]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(gone - lines.first[at], pa.int32()),
                    pa.array(lines.start[gone] - offsets[at], pa.int32()),
                    pa.array(lines.end[gone] - offsets[at], pa.int32()),
                    pa.array([RULES[i] for i in rule[gone].tolist()], pa.string()),
                ],
                ["line", "start", "end", "rule"],
            )
            failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
            columns = [
                rows.column("id"),
                pa.array(texts, pa.string()),
                lists(spans, np.bincount(at, minlength=n)),
                *[pa.array(x.astype(np.int64)) for x in (words, np.diff(inside[offsets]), np.diff(symbols[offsets]), twice, repeated, lost)],
                pa.array(failed),
                pa.array(~failed & (100 * lost <= MOST_LOST * words)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, {SCHEMA}")


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document, with what its lines lost and a digest of what they leave."""
    cleaned = clean(table(spark, sf_dir, "documents"))
    return cleaned.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.size("removed").cast("long").alias("n_lines_removed"),
        "n_words_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("cleaned_sha256"),
    )


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
lw AS (SELECT *, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l),
lc AS (SELECT r, k, line, w, len(w) AS n,
    len(list_filter(w, lambda x: x IN ({_quoted(SEPARATORS)}))) AS separators,
    len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS symbols,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shouted,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(re.escape(p) for p in PHRASES)}') AS phrased,
    right(w[len(w)], 1) IN ({_quoted(ENDS)}) AS well FROM lw),
lv AS (SELECT *, n > 0 AND ((separators >= 2 AND 100 * separators >= 20 * n) OR (n >= 3 AND 100 * symbols > 30 * n)
    OR (n >= 3 AND 2 * shouted > n) OR (n >= 4 AND 2 * same > n) OR (n <= {PHRASE_WORDS} AND phrased) OR NOT well) AS gone,
    n > 0 AND row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS twice FROM lc),
a AS (SELECT r, sum(n)::BIGINT AS n_words, count(*) FILTER (WHERE twice) AS n_dup_lines, count(*) FILTER (WHERE gone) AS n_lines_removed,
    coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_words_removed,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS cleaned,
    sum(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0))::BIGINT AS word_chars FROM lv GROUP BY r),
x AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM x WHERE len(w) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS again FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE again) GROUP BY r),
f AS (SELECT doc_id, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines_removed, n_words_removed, sha256(cleaned) AS cleaned_sha256
    FROM d JOIN a USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * n_words_removed <= {MOST_LOST} * n_words AS kept FROM f
"""
