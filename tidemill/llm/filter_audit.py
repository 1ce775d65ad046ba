"""Operator 13: how filters interact, by contractions of a contingency tensor per part.

Every document gets one bit per filter (does it fail?). Counting the bit patterns per part, a grouping
Spark combines before its shuffle, is all that depends on the number of documents: what comes out are
2^n counts a part, however large the part. Per part these counts are reshaped to 2x2x...x2, and one
einsum answers every step of every order: along each axis a selector takes passing, failing or all
documents. Parts are spread over tasks; nothing is gathered on the driver.
"""

from __future__ import annotations

from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, table

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def _selectors(names: str, asked: list[dict[str, tuple[int, int]]]) -> list[np.ndarray]:
    """One (questions, 2) array per axis; an axis that a question doesn't name takes all."""
    return [np.array([question.get(name, _ALL) for question in asked], np.int64) for name in names]


def contract(tensor: np.ndarray, names: str, asked: list[dict[str, tuple[int, int]]]) -> np.ndarray:
    """(questions, measures) counts from a (measures, 2, ..., 2) tensor, axis value 1 being a failure."""
    axes = ascii_lowercase[: len(names)]
    spec = "z" + axes + "," + ",".join("y" + a for a in axes) + "->yz"
    return np.einsum(spec, tensor, *_selectors(names, asked), optimize=True)


def audit_tensor(tensor: np.ndarray, names: str) -> pd.DataFrame:
    """One row per order of the filters and step, from a part's tensor of (n, good, toxic) counts."""
    steps = [(order, k) for order in map("".join, permutations(names)) for k in range(len(names))]

    def asked(last: tuple[int, int] | None) -> list[dict[str, tuple[int, int]]]:
        """The filters before a step passed, its own as `last` says."""
        return [dict.fromkeys(order[:k], _PASS) | ({order[k]: last} if last else {}) for order, k in steps]

    kept, removed = contract(tensor, names, asked(_PASS)), contract(tensor, names, asked(_FAIL))
    each = {f: i for i, f in enumerate(names)}
    fails = contract(tensor, names, [{f: _FAIL} for f in names])[:, 0]
    alone = contract(tensor, names, [dict.fromkeys(names, _PASS) | {f: _FAIL} for f in names])[:, 0]
    own = np.array([each[order[k]] for order, k in steps])
    shapley = np.zeros(len(names), np.int64)
    np.add.at(shapley, own, removed[:, 0])
    return pd.DataFrame(
        {
            "filter_order": [order for order, _ in steps],
            "step": np.array([k + 1 for _, k in steps], np.int32),
            "kept": kept[:, 0],
            "removed": removed[:, 0],
            "redundant": fails[own] - removed[:, 0],
            "unique_fails": alone[own],
            "good_lost": removed[:, 1],
            "toxic_lost": removed[:, 2],
            "shapley": shapley[own],
        }
    )


def contingency(rows: DataFrame, filters: dict[str, str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, pattern, n, good, toxic): documents by part and bit pattern, bit i set where filter i fails.

    `filters` names the boolean failure column of each one-letter filter; null counts as not failing.
    """
    bits = [F.when(F.col(column), F.lit(1 << i)).otherwise(0) for i, column in enumerate(filters.values())]
    pattern = sum(bits[1:], bits[0])
    return rows.groupBy(F.col(part).alias("part"), pattern.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.count_if(toxic).alias("toxic")
    )


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit of each part of `contingency`: every order of the filters, every step, zeros included."""
    shape = (2,) * len(names)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((len(MEASURES), 2 ** len(names)), np.int64)
        for m, name in enumerate(MEASURES):
            tensor[m, rows["pattern"].to_numpy()] = rows[name].to_numpy()
        # Bit 0 is the last axis of a C-ordered array.
        tensor = tensor.reshape(len(MEASURES), *shape).transpose(0, *range(len(names), 0, -1))
        out = audit_tensor(tensor, names)
        out.insert(0, "part", key[0])
        return out

    columns = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {columns}")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n_words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), one row per row of `documents`.

    E: an equal text stands at a smaller id, anywhere in the table. Rows of one id don't precede each
    other; a null id precedes none and follows none. Null and empty texts are equal; a null part is the
    empty one. A document is good (toxic) if a label row of its id has quality (toxic) 1; ids without
    labels, and null labels, are neither. Texts are read once; what is shuffled are digests and bits.
    """
    text = F.col(text_column)
    found = documents.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"),
        *[failed.alias(name) for name, failed in text_failures(text).items()],
    )
    found = materialize(found, "audited")
    firsts = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    marked = labels.groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    copies = materialize(firsts.select("digest", "first"), "copied")
    return (
        found.join(copies, "digest", "left")
        .join(marked, "id", "left")
        .select("part", *"ABCD", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), "good", "toxic")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over the whole documents table, audited per source in all 120 orders."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = judged(documents, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return audit(contingency(rows, {f: f for f in FILTERS}))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
     'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS s
    FROM w LEFT JOIN m USING (doc_id)),
g AS (SELECT part, s, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic,
    MAP {'A': s.A, 'B': s.B, 'C': s.C, 'D': s.D, 'E': s.E} AS fails FROM f GROUP BY part, s),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
q AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(filter_order[1:step - 1], '') AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (SELECT q.*, g.part, n, good, toxic, fails[own] AS failed,
    len(list_filter(before, lambda b: b <> '' AND fails[b])) > 0 AS gone,
    len(list_filter(map_values(fails), lambda v: v)) AS n_failed FROM q, g),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM h GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
