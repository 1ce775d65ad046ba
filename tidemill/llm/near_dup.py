"""Operator 4: near-duplicates by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct shingles. Equal sets are one class from the
start, however many documents have them. For each of 128 hash functions a class keeps the smallest
value in compressed form: the number of leading zeros and ten bits after them. Bands of four
registers are buckets: sets alike to 0.8 share one of 32 buckets but for one pair in 20 million.

Within a bucket, members meet a representative, not each other. A group of copies is done after that,
with as many pairs as members. What is left shares buckets with members of other components: mostly
texts of one template, alike but below the threshold. These have all met one representative, and two
of them can only be linked if they differ from it in the same shingles, in so many that they share
one of the rarest of these. By such shingles they are put into new buckets and meet again: 64
representatives for each bucket at first, then 64 times as many in each round, until all members
left of a bucket are in one component. Two members are a pair there only if the sizes of their
differences, and the places of the bucket's shingle in the order by rarity, leave room for enough
shared ones. In the end every pair of a bucket has met, can't be alike, or is known to be connected,
so no link is lost. Pairs whose registers (corrected for equal registers of different sets) put them
well below the threshold are dropped; the rest is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import (
    LOWER,
    NOT_SPACE,
    gram_hashes,
    materialize,
    mixed,
    packed,
    prefix_sums,
    span_hashes,
    steps,
    table,
    word_spans,
)

REGISTERS = 128
BAND = 4
MANTISSA = 10
#: Estimates may fall short by this much: five standard deviations of 128 registers at 0.8.
MARGIN = 0.18
#: How many times as many representatives a bucket has in the next round.
GROWTH = 64

#: Classes that one copy of a representative's text is compared with.
MEETINGS = 256

_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(low: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and their numbers by row.

    A row of fewer words than `size`, but some, has one shingle of all of them.
    """
    starts, ends, rows = word_spans(low, offsets, NOT_SPACE)
    hashes = span_hashes(prefix_sums(low), starts, ends)
    n_rows = len(offsets) - 1
    n_words = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(n_words) - n_words
    grams = gram_hashes(hashes, size)
    inside = np.flatnonzero(rows[: len(grams)] == rows[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, owners = [grams[inside]], [rows[inside]]
    for length in range(1, size):
        at = first[n_words == length]
        if len(at):
            values.append(gram_hashes(hashes, length)[at])
            owners.append(rows[at])
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=n_rows)


def registers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Compressed minima by row and hash function, as 16-bit numbers; only rows with values."""
    filled = counts[counts > 0]
    begin = np.cumsum(filled) - filled
    out = np.zeros((len(filled), REGISTERS), np.uint16)
    spread = mixed(values)
    with np.errstate(over="ignore"):
        for k in range(REGISTERS):
            # The high half of a product of a mixed value by an odd factor is a new hash of it.
            least = np.minimum.reduceat(spread * _FACTORS[k], begin)
            zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 62).astype(np.uint64)
            tail = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
            out[:, k] = (zeros << np.uint64(MANTISSA)) | tail
    return out


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that a register of disjoint sets of these sizes is equal, after its compression.

    A register's cell covers minima of one exponent and mantissa; the smallest of n uniform values
    falls into a cell with a probability that is summed over the exponents, within which the
    mantissa's cells are near enough equal.
    """
    total = np.zeros(len(a))
    for zeros in range(64):
        high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)
        p = [np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-min(high, 1 - 1e-16))) for n in (a, b)]
        total += p[0] * p[1] / 2**MANTISSA
    return total


def estimate(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers of sets of a and b values, corrected for chance matches."""
    equal = (x == y).mean(axis=1)
    chance = collision_rate(a.astype(float), b.astype(float))
    return np.clip((equal - chance) / (1 - chance), 0.0, 1.0)


def _sketches(documents: DataFrame, size: int) -> DataFrame:
    """Per row of (id, mark, text): its set's size, digest and sketch."""
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for rows, data, offsets in steps(batches):
            values, counts = shingle_sets(LOWER[data], offsets, size)
            filled = np.flatnonzero(counts)
            sketch = np.zeros((rows.num_rows, REGISTERS), np.uint16)
            first, second = np.zeros(rows.num_rows, np.uint64), np.zeros(rows.num_rows, np.uint64)
            if len(filled):
                sketch[filled] = registers(values, counts)
                begin = (np.cumsum(counts) - counts)[filled]
                with np.errstate(over="ignore"):
                    first[filled] = np.add.reduceat(mixed(values + np.uint64(1)), begin)
                    second[filled] = np.add.reduceat(mixed(values ^ np.uint64(0xA24BAED4963EE407)), begin)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": serial + np.arange(rows.num_rows),
                    "id": rows.column("id"),
                    "mark": rows.column("mark"),
                    "n": counts.astype(np.int64),
                    "digest": pa.array([a + b for a, b in zip(_bytes(first), _bytes(second), strict=True)], pa.binary()),
                    "sketch": pa.array([s.tobytes() for s in sketch], pa.binary()),
                }
            )
            serial += rows.num_rows

    return documents.mapInArrow(run, f"row long, id {kind}, mark long, n long, digest binary, sketch binary")


def _bytes(values: np.ndarray) -> list[bytes]:
    raw = values.astype("<u8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, class) for each band of a class's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // BAND
        salt = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            if batch.num_rows:
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, bands, BAND)
                key = sketch.astype(np.uint64)
                packed = key[:, :, 0] | (key[:, :, 1] << np.uint64(16)) | (key[:, :, 2] << np.uint64(32)) | (key[:, :, 3] << np.uint64(48))
                with np.errstate(over="ignore"):
                    bucket = mixed(mixed(packed) + salt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel().view(np.int64)), pa.array(np.repeat(batch.column("class").to_numpy(), bands))], ["bucket", "class"]
                )

    return classes.select("class", "sketch").mapInArrow(run, "bucket long, class long")


def components(links: DataFrame, labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """(class, component): the smallest class reachable over links (a, b), by label passing.

    `labels` holds every class with a class it is known to be connected with, itself at first. With
    `rounds`, passing ends after so many: labels then name connected classes, not yet the smallest.

    Labels move to all neighbours and then to what the label's own vertex has learnt, so chains
    halve with every round. Each round is written to the shared folder.
    """
    edges = links.select("a", "b").union(links.select("b", "a"))
    while True:
        near = edges.join(labels, edges.a == labels["class"]).groupBy(F.col("b").alias("class")).agg(F.min("component").alias("other"))
        lower = labels.join(near, "class", "left").select("class", F.least("component", F.coalesce("other", "component")).alias("mid"), F.col("component").alias("old"))
        lower = materialize(lower, "labels")
        up = lower.select(F.col("class").alias("mid"), F.col("mid").alias("top"))
        after = lower.join(up, "mid", "left").select("class", F.coalesce("top", "mid").alias("component"), "old")
        after = materialize(after, "labels")
        labels = after.select("class", "component")
        rounds = rounds and rounds - 1
        if rounds == 0 or after.where("component != old").isEmpty():
            return labels


def _meet(active: DataFrame, slots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of this round, members of a bucket with representatives of other components, and these.

    A bucket has one representative for each slot: the class that shares buckets most, which in a
    group of variants is the one nearest to all. A pair that is alike shares at least
    (d + e - r (n + m)) / 2 of its differences (see _by_differences), and in the bucket of the first
    that it shares, no more can follow than either has left.
    """
    slot = F.pmod(F.xxhash64("class", F.lit(slots)), F.lit(slots))
    facts = F.struct("weight", "class", "component", "n", "d", "place")
    chosen = active.where("lead").groupBy("bucket", slot.alias("slot")).agg(F.max(facts).alias("r"))
    chosen = chosen.selectExpr("bucket", "r.class as rep", "r.component as home", "r.n as m", "r.d as e", "r.place as spot")
    chosen = materialize(chosen, "representatives")
    more, less = 100 + percent, 100 - percent
    room = F.expr(f"{more} * (d + e) - {less} * (n + m) <= {2 * more} * (1 + least(d - place, e - spot))")
    pairs = active.join(chosen, (active.bucket == chosen.bucket) & F.expr("component != home") & room)
    return pairs.select(F.least("class", "rep").alias("a"), F.greatest("class", "rep").alias("b")), chosen


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is not clearly below the threshold."""
    sketches = classes.select("class", "n", "sketch")
    with_a = pairs.join(sketches.selectExpr("class as a", "n as na", "sketch as sa"), "a")
    both = with_a.join(sketches.selectExpr("class as b", "n as nb", "sketch as sb"), "b")
    # A set of which the other has less than the threshold cannot be alike.
    both = both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                alike = estimate(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(alike >= threshold - MARGIN))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = packed(column)
    values, counts = shingle_sets(LOWER[data], offsets, size)
    return np.split(values, np.cumsum(counts)[:-1])


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets, made from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in steps(batches, "x"):
            kept = []
            for x, y in zip(_sets(batch.column("x"), size), _sets(batch.column("y"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    own = texts.join(wanted, "class", "left_semi")
    joined = pairs.join(own.selectExpr("class as a", "text as x"), "a").join(own.selectExpr("class as b", "text as y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _by_differences(met: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, class, lead, n, d, place) for classes by the shingles in which they differ from representatives met.

    Let D(x) be the shingles that only one of x and the representative B has. Sets x and y alike to
    the threshold p share at least (|D(x)| + |D(y)| - r (|x| + |y|)) / 2 of these, r = (1-p) / (1+p).
    If neither is linked with B, |D(y)| > r (|y| + |B|), so they share more than
    (|D(x)| + r (|B| - |x|)) / 2: any two such sets share one of the rarest |D(x)| - floor(that). The
    same bound holds for a linked x against an unlinked y; for an unlinked x against a linked y it
    is (|D(x)| - r (|x| + |B|)) / 2, since |D(y)| is at least the difference of the sizes. Two sets
    linked with B are connected. So unlinked classes meet in buckets of their own, and linked ones
    lead the buckets in which the unlinked meet them. n is |x|, d is |D(x)|, and place that of the
    bucket's shingle in D(x), rarest first.
    """
    more, less = 100 + percent, 100 - percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in steps(batches, "x"):
            tokens, counts, sizes, first, second, free = [], [], [], [], [], []
            for x, y in zip(_sets(rows.column("x"), size), _sets(rows.column("y"), size), strict=True):
                own = np.setxor1d(x, y, assume_unique=True)
                d = len(own)
                shared = (more * d + less * (len(y) - len(x))) // (2 * more)
                unlinked = more * d > less * (len(x) + len(y))
                fewer = max(1, -(-(more * d - less * (len(x) + len(y))) // (2 * more)))
                tokens.append(own)
                counts.append(d)
                sizes.append(len(x))
                first.append(d - shared if unlinked else 0)
                second.append(d - fewer + 1 if unlinked else d - shared)
                free.append(unlinked)
            index = np.repeat(np.arange(rows.num_rows), counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "class": rows.column("class").take(pa.array(index)),
                    "rep": rows.column("rep").take(pa.array(index)),
                    "shingle": np.concatenate(tokens).view(np.int64),
                    "n": np.array(sizes, np.int64)[index],
                    "d": np.array(counts, np.int64)[index],
                    "among_free": np.array(first, np.int64)[index],
                    "with_linked": np.array(second, np.int64)[index],
                    "free": np.array(free, bool)[index],
                }
            )

    wanted = met.select("class").union(met.select("rep")).distinct()
    own = texts.join(wanted, "class", "left_semi")
    # A representative that thousands have met is dealt out with its text, a share of them to each copy.
    hot = met.groupBy("rep").agg(F.ceil(F.count("*") / MEETINGS).cast("int").alias("shares")).where("shares > 1")
    hot = materialize(hot, "hot")
    shares = F.coalesce("shares", F.lit(1))
    dealt = met.join(hot, "rep", "left").select("class", "rep", F.pmod(F.xxhash64("class"), shares).cast("int").alias("share"))
    copies = own.selectExpr("class as rep", "text as y").join(hot, "rep", "left")
    copies = copies.select("rep", "y", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    joined = dealt.join(own.withColumnRenamed("text", "x"), "class").join(copies, ["rep", "share"])
    schema = "class long, rep long, shingle long, n long, d long, among_free long, with_linked long, free boolean"
    differing = materialize(joined.select("class", "rep", "x", "y").mapInArrow(run, schema), "differences")
    seen = materialize(differing.groupBy("rep", "shingle").agg(F.count("*").alias("df")), "frequencies")
    order = Window.partitionBy("class", "rep").orderBy("df", "shingle")
    ranked = differing.join(seen, ["rep", "shingle"]).withColumn("place", F.row_number().over(order).cast("long"))
    ranked = materialize(ranked.where("df > 1 and place <= greatest(among_free, with_linked)"), "ranked")
    facts = ["class", "n", "d", "place"]
    among = ranked.where("free and place <= among_free").select(F.xxhash64("rep", "shingle", F.lit(1)).alias("bucket"), *facts, F.lit(True).alias("lead"))
    across = ranked.where("place <= with_linked").select(F.xxhash64("rep", "shingle", F.lit(2)).alias("bucket"), *facts, (~F.col("free")).alias("lead"))
    return among.unionByName(across)


def _open(state: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components and someone to lead."""
    several = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("lead").alias("led"))
    several = materialize(several.where("low != high and led").select("bucket"), "open")
    return materialize(state.join(several, "bucket", "left_semi"), "state")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id of its group) and kept.

    Words are lower-cased (A-Z) runs without white space. A text of no words, empty or null has an
    empty set and is linked with nothing but is no error: its component is its own id. Rows without
    an id take part; a group's smallest id leaves them out, and a group of them alone has none and
    keeps its rows. Repeated rows are one class; rows that share the kept id are all kept.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("mark"), F.col(text_column).alias("text"))
    rows = materialize(_sketches(texts, size), "sketches")
    # A class is named by the first row of its set.
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct("row", "id", "mark")).alias("r"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes.select(F.col("r.row").alias("class"), "r.id", "r.mark", "digest", "least_id", "n", "sketch"), "classes")
    buckets = materialize(_bands(classes), "bands")
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    active = materialize(buckets.join(shared, "bucket"), "active")
    in_play = materialize(active.groupBy("class").agg(F.sum("k").alias("weight")), "in_play")
    playing = classes.join(in_play, "class", "left_semi")
    sketches = materialize(playing.select("class", "n", "sketch"), "playing")
    named = playing.select("class", F.col("id").alias("i"), F.col("mark").alias("m"))
    bodies = materialize(texts.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("class", "text"), "texts")

    labels = materialize(in_play.select("class", F.col("class").alias("component")), "labels")
    state = active.select("bucket", "class").join(in_play, "class").join(sketches.select("class", "n"), "class")
    state = state.withColumns({"d": F.lit(0).cast("long"), "place": F.lit(0).cast("long"), "component": F.col("class"), "lead": F.lit(True)})
    state = materialize(state, "state")
    links, slots, again, whole = None, 1, False, True
    while not state.isEmpty():
        pairs, chosen = _meet(state, slots, percent)
        plausible = materialize(_plausible(pairs.distinct(), sketches, percent / 100), "plausible")
        found = materialize(_confirmed(plausible, bodies, size, percent), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            # Until the end labels only save comparisons; a few steps do for members around representatives.
            labels, whole = components(links, labels, 1 if again else 2), False
        # Representatives have met all others of their bucket; buckets of one component are done.
        left = state.drop("component").join(chosen.select("bucket", F.col("rep").alias("class")), ["bucket", "class"], "left_anti")
        state = _open(materialize(left.join(labels, "class"), "left"))
        slots *= GROWTH
        if not again and not state.isEmpty():
            # Every pair that may still be linked shares one of these buckets, so it has met one representative.
            met = materialize(state.select("bucket", "class").join(chosen.select("bucket", "rep"), "bucket").select("class", "rep").distinct(), "met")
            members = _by_differences(met, bodies, size, percent).join(labels, "class").join(in_play, "class")
            state, again, slots = materialize(members, "members"), True, GROWTH
    if not whole:
        labels = components(links, labels)

    grouped = classes.select("digest", "class", "least_id").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    grouped = materialize(grouped, "grouped")
    least = materialize(grouped.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    named = materialize(grouped.join(least, "component").select("digest", "component_id"), "named")
    out = rows.where("n > 0").select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 0.8 of their four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
