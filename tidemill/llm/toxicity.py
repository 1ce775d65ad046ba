"""Operator 5: toxicity by a weighted lexicon.

Text and lexicon are folded alike: lower case, look-alike letters of other scripts, digits and signs
that stand for letters, and i, l, 1 and | as one letter; zero-width characters go. The lexicon is
learned: prefixes of words that labelled toxic rows have and others hardly have, each as short as it
is precise, with its log odds as weight. Aho-Corasick finds them in whole texts where a word begins;
a hit inside an exception phrase doesn't count, and the repetition of one entry counts by its logarithm. Exception phrases
are learned too: a word that an entry finds, with the word before or behind it, where the rows that
have both are hardly ever toxic. The weights' sum, plain and divided by the text's
length, gives the score by a logistic fit. Learning takes a bounded number of labelled rows; scoring
takes all rows and nothing but their text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import bucket_of, materialize, steps, table

#: Labelled rows that learning takes at most, of each label: those with the smallest hash of their id.
SAMPLE_ROWS = 4_000
PREFIX_SIZES = range(3, 13)
PRECISION = 0.9
#: Different places in toxic rows that an entry must stand in at least, however few rows there are.
LEAST_ROWS = 4
LEXICON_SIZE = 5_000
THRESHOLD = 0.7

#: Phrases known beforehand in which a word of the lexicon means no harm; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser rule")

# Letters that look like Latin ones, and signs written for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i", "ı": "i",
}
_DROPPED = "​‌‍⁠﻿­"
_FOLD = str.maketrans({**_LOOKALIKES, **{c: None for c in _DROPPED}, **{chr(0xFF41 + k): chr(97 + k) for k in range(26)}, "ｌ": "i"})


_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Model:
    """Folded prefixes with weights, folded exception phrases, and the logistic fit."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    fit: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        for prefix, weight in self.lexicon.items():
            machine.add_word(prefix, (len(prefix), weight))
        if len(machine):
            machine.make_automaton()
        return machine


def _hits(folded: str, machine) -> dict[int, tuple[int, float]]:
    """End and weight of the longest entry at each place where a word begins, without those inside exception phrases."""
    excused, hits = [], []
    for end, (size, value) in machine.iter(folded) if len(machine) else ():
        start = end + 1 - size
        if start and folded[start - 1].isalnum():
            continue
        if value is None:
            excused.append((start, end))
        else:
            hits.append((start, end, value))
    best: dict[int, tuple[int, float]] = {}
    # By place: of the phrases that begin up to here the one that ends last covers most.
    excused.sort()
    begun, covered = 0, -1
    for start, end, value in sorted(hits):
        while begun < len(excused) and excused[begun][0] <= start:
            covered = max(covered, excused[begun][1])
            begun += 1
        if end > covered:
            best[start] = max(best.get(start, (0, 0.0)), (end, value))
    return best


def _features(text: str, machine) -> tuple[float, float, float]:
    """Log of the hits' weight, that weight by the square root of the words, and by the words."""
    weight = 0.0
    if len(machine):
        folded = fold(text)
        # A text that says one word over and over says little more than once.
        times = Counter((folded[start:end], value) for start, (end, value) in _hits(folded, machine).items())
        weight = sum(value * (1 + np.log(n)) for (_, value), n in times.items())
    words = text.count(" ") + text.count("\n") + 1
    return np.log1p(weight), weight / np.sqrt(words), min(weight / words, 1.0)


def _phrases(text: str, machine) -> dict[str, str]:
    """Words that entries find, each with the word before and with the one behind, and the words around the two."""
    folded, out = fold(text), {}
    hits = _hits(folded, machine)
    spans = [m.span() for m in _WORD.finditer(folded)] if hits else []

    def word(k: int) -> str:
        return folded[slice(*spans[k])] if 0 <= k < len(spans) else ""

    for k, (start, _) in enumerate(spans):
        if start in hits:
            for a in (k - 1, k):  # words a and a + 1, one of which is the hit
                if a >= 0 and a + 1 < len(spans) and folded[spans[a][1] : spans[a + 1][0]] == " ":
                    out[folded[spans[a][0] : spans[a + 1][1]]] = f"{word(a - 1)} {word(a + 2)}"
    return out


def _exceptions(rows: DataFrame, model: Model, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """Phrases around the lexicon's hits that clean rows have in several places and toxic ones hardly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch, data, ends in steps(batches, size=1 << 19):
            raw = data.tobytes()
            found = [_phrases(raw[a:b].decode(), machine) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            toxic = np.repeat(batch.column("toxic").to_numpy(), [len(f) for f in found])
            contexts = [zlib.crc32(around.encode()) for f in found for around in f.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for f in found for p in f], pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic.astype(np.int32))], ["phrase", "context", "toxic"]
            )

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "phrase string, context long, toxic int")
    places = found.groupBy("phrase", "context").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    counts = places.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("clean") > 0).alias("contexts"))
    share = F.col("clean") / n_clean
    harmless = counts.where((F.col("contexts") >= LEAST_ROWS) & (share >= PRECISION * (share + F.col("toxic") / n_toxic)))
    return tuple(r.phrase for r in harmless.orderBy(F.desc("clean"), "phrase").limit(LEXICON_SIZE).collect())


def _prefixes(rows: DataFrame) -> DataFrame:
    """(prefix, context, toxic): each prefix of a row's folded words once, and a hash of the words around one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in steps(batches, size=1 << 19):
            raw = data.tobytes()
            found, contexts, counts = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                words = [w.strip(".,;:!?\"'()[]") for w in fold(raw[a:b].decode()).split()]
                around = dict(zip(words, zip(["", *words], [*words[1:], ""], strict=False), strict=True))
                own = {w[:n]: beside for w, beside in around.items() for n in PREFIX_SIZES if len(w) >= n}
                found.extend(own)
                contexts.extend(zlib.crc32(" ".join(beside).encode()) for beside in own.values())
                counts.append(len(own))
            toxic = np.repeat(batch.column("toxic").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic.astype(np.int32))], ["prefix", "context", "toxic"]
            )

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "prefix string, context long, toxic int")


def _lexicon(counts: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The shortest precise prefixes, lengthened as long as that loses next to nothing of rows times weight."""
    toxic = {r.prefix: (r.toxic, r.clean) for r in counts}
    children: dict[str, list[str]] = {}
    for prefix in toxic:
        children.setdefault(prefix[:-1], []).append(prefix)

    def weight(prefix: str) -> float:
        t, c = toxic[prefix]
        return float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))

    def worth(prefix: str) -> float:
        return toxic[prefix][0] * weight(prefix)

    out = {}
    for prefix in toxic:
        if prefix[:-1] in toxic:
            continue
        while (longer := max(children.get(prefix, ()), key=worth, default=None)) and worth(longer) >= 0.98 * worth(prefix):
            prefix = longer
        out[prefix] = weight(prefix)
    return {p: w for p, w in out.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, ...]:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
    return tuple(w.tolist())


def learn(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          *, exceptions: tuple[str, ...] = EXCEPTIONS, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows of each label.

    Null ids and labels are left out; of several labels for an id the largest holds. Without toxic
    rows, or without others, the lexicon is empty and every score is 0. `exceptions` hold besides the
    learned ones, of which there are `LEXICON_SIZE` at most, as of entries.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).alias("toxic"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    sample = known.where("toxic").orderBy(*by_hash).limit(rows).unionByName(known.where("not toxic").orderBy(*by_hash).limit(rows))
    sample = materialize(sample, "labelled")
    texts = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    chosen = materialize(texts.join(sample, "id").select("toxic", "text"), "training")
    n_toxic, n_all = chosen.agg(F.count_if(F.col("toxic")), F.count("*")).first()
    folded = tuple(fold(e) for e in exceptions)
    if not 0 < n_toxic < n_all:
        return Model({}, folded)
    counts = _prefixes(chosen).groupBy("prefix", "context").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    # Copies of one toxic text share all of its words, but each in one place: a word that harms stands in many.
    counts = counts.groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("contexts"))
    # Precise in rows of equal weight for both labels.
    share = F.col("toxic") / n_toxic
    counts = materialize(counts, "prefixes")
    # So many places that chance alone would not put all of them into toxic rows for one prefix of all there are.
    least = max(LEAST_ROWS, int(np.ceil(np.log(max(counts.count(), 1)) / np.log(n_all / n_toxic))))
    precise = counts.where((F.col("contexts") >= least) & (share >= PRECISION * (share + F.col("clean") / (n_all - n_toxic))))
    lexicon = _lexicon(precise.orderBy(F.desc("toxic"), "prefix").limit(LEXICON_SIZE).collect(), n_toxic, n_all - n_toxic)
    model = Model(lexicon, folded)
    folded += tuple(e for e in _exceptions(chosen, model, n_toxic, n_all - n_toxic) if e not in folded)
    model = Model(lexicon, folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            f = np.array([_features(t, machine) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(f[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    points = chosen.mapInArrow(run, "toxic boolean, a double, b double, c double").collect()
    x = np.array([(p.a, p.b, p.c) for p in points])
    return Model(lexicon, folded, _logistic(x, np.array([float(p.toxic) for p in points])))


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row; null counts as empty. Repeated rows get equal scores."""
    chosen = documents.select(id_column, text_column)
    return with_score(chosen, model, text_column, "score" if "score" != id_column else "value").drop(text_column)


def with_score(documents: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All rows and columns of `documents` and their score, under a name that is still free (`ValueError` else)."""
    if score_column in documents.columns:
        raise ValueError(f"a column {score_column} exists already")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        machine = own.automaton()
        for rows, data, ends in steps(batches, text_column):
            raw = data.tobytes()
            f = np.array([_features(raw[a:b].decode(), machine) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            value = np.zeros(rows.num_rows)
            if own.fit:
                value = 1 / (1 + np.exp(-np.clip(f @ np.array(own.fit[:-1]) + own.fit[-1], -30, 30)))
            yield rows.append_column(score_column, pa.array(value))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    return documents.mapInArrow(run, ", ".join([*fields, f"`{score_column}` double"]))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the tables' own labels, without those of the held-out third."""
    labels = table(spark, sf_dir, "labels")
    return learn(table(spark, sf_dir, "documents"), labels.where(bucket_of("doc_id", 3) != 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    scored = score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
