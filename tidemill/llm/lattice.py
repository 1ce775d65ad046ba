"""Operator 9: language-model scores from subword lattices.

A word's probability is the sum over all ways to segment it into pieces of an existing vocabulary,
by forward recursion in log space; the pieces' weights start from the vocabulary's own scores and are
fitted to the training words by expectation maximisation. A word that training has seen is a unit of
its own as well: its count, less a discount, and the discounts' mass goes to the lattice. So

    P(token) = max(c - D, 0) / N + D * U / N * lattice(token),   P(end) = c(end) / N,

with U distinct training words and D = n1 / (n1 + 2 n2) from the numbers of those seen once and
twice, is a distribution over all words, and a text's probability is the
product over its words and one end.

Documents are read once, in blocks of some 32 MB of text whose words are numbered. Counts are joined
by (block, distinct word), never by token, so a frequent word is one row per block and no hot key.
Held by the driver: the vocabulary's weights (its size is fixed) and totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, NOT_SPACE, bucket_of, lists, materialize, mixed, powers, prefix_sums, span_hashes, steps, table, word_spans

BLOCK_BYTES = 32 << 20
#: Words of a block that share one row of the block's word list.
LIST_WORDS = 2_000
ROUNDS = 2
_SPACE = "▁"
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Vocabulary:
    """Pieces of a sentencepiece model, found in words by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(len(self.pieces))])
        # Pieces that hold capitals or a space mark elsewhere than in front cannot occur.
        usable &= np.array([p == p.lower() and _SPACE not in p[1:] for p in self.pieces])
        self.first = np.array([p.startswith(_SPACE) for p in self.pieces])
        ranks = np.array([-model.get_score(i) for i in range(len(self.pieces))], float)
        # The scores are ranks; weights start by Zipf's law of them.
        self.start = np.where(usable, 1.0 / (10.0 + np.maximum(ranks, 0)), 0.0)
        ids = np.flatnonzero(usable)
        self.longest = max(len(self.pieces[i]) for i in ids)
        keys = np.array([self.sums(np.array([[ord(c)] for c in self.pieces[i]], np.uint64))[-1, 0] for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        # One bit for each leading pattern of a mixed key: most spans that are no piece end here.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slots(self.keys)] = True

    @staticmethod
    def sums(codes: np.ndarray) -> np.ndarray:
        """Prefix sums of characters by word: (characters + 1, words) for (characters, words)."""
        with np.errstate(over="ignore"):
            terms = mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes))[:, None]
            out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
            np.cumsum(terms, axis=0, out=out[1:])
        return out

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def spans(self, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The spans of `size` characters that are pieces: start * words + word, and piece ids."""
        words = sums.shape[1]
        with np.errstate(over="ignore"):
            keys = (sums[size:] - sums[:-size]) * powers(_INVERSE, len(sums))[: len(sums) - size, None]
        at = np.flatnonzero(self.maybe[self.slots(keys)])
        found = keys.ravel()[at]
        place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        same = self.keys[place] == found
        at, ids = at[same], self.ids[place[same]]
        allowed = (at < words) | ~self.first[ids]  # only a word's own start takes a piece that opens words
        return at[allowed], ids[allowed]


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Weights:
    """Log probabilities: pieces that open a word, pieces within it, bytes of characters no piece has."""

    def __init__(self, own: Vocabulary, counts: np.ndarray):
        """counts: by piece, then 256 by byte, then the number of words."""
        pieces, spare, words = counts[: len(own.pieces)], counts[-257:-1] + 1e-3, counts[-1]
        usable = own.start > 0
        pieces = np.where(usable, pieces + 1e-6 * own.start / own.start.sum() * max(words, 1.0), 0.0)
        opening = pieces[own.first].sum()
        inner = pieces[~own.first].sum() + spare.sum()
        # After each piece a word goes on or ends; both are taken from the expected numbers.
        go_on = inner / (inner + max(words, 1e-9))
        with np.errstate(divide="ignore"):
            self.pieces = np.where(own.first, np.log(pieces / opening), np.log(pieces / inner) + np.log(go_on))
        self.bytes = np.log(spare / inner) + np.log(go_on)
        self.stop = float(np.log1p(-go_on))


def initial_counts(own: Vocabulary) -> np.ndarray:
    opening, inner = own.start[own.first].sum(), own.start[~own.first].sum()
    counts = np.where(own.first, own.start / opening, own.start / inner * 2.0)
    return np.concatenate([counts, np.full(256, 1e-5), [1.0]])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their indexes and characters, the space mark in front."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        for index in np.array_split(every, max(1, len(every) * int(size) // (1 << 16))):
            joined = "".join(_SPACE + words[k] for k in index.tolist())
            yield index, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(index), int(size) + 1)


class Lattice:
    """All segmentations of words of one length, and the recursions over them."""

    def __init__(self, own: Vocabulary, weights: Weights, codes: np.ndarray):
        self.own, self.weights = own, weights
        self.codes = codes = np.ascontiguousarray(codes.T)
        self.length, self.words = codes.shape
        sums = own.sums(codes)
        self.edges, self.costs = [], []
        for size in range(1, min(own.longest, self.length) + 1):
            at, ids = own.spans(sums, size)
            cost = np.full((self.length + 1 - size, self.words), -np.inf)
            cost.ravel()[at] = weights.pieces[ids]
            self.edges.append((at, ids))
            self.costs.append(cost)
        # A character that is no piece is spelled by its UTF-8 bytes.
        self.bare = np.flatnonzero(np.isneginf(self.costs[0]).ravel())
        kinds, back = np.unique(codes.ravel()[self.bare], return_inverse=True)
        self.spelling = [list(chr(c).encode("utf-8", "surrogatepass")) for c in kinds.tolist()]
        self.kind = back
        if len(kinds):
            self.costs[0].ravel()[self.bare] = np.array([weights.bytes[b].sum() for b in self.spelling])[back]

    def forward(self) -> np.ndarray:
        alpha = np.full((self.length + 1, self.words), -np.inf)
        alpha[0] = 0.0
        for j in range(1, self.length + 1):
            alpha[j] = _logsum(np.stack([alpha[j - m] + self.costs[m - 1][j - m] for m in range(1, min(j, len(self.costs)) + 1)]))
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full((self.length + 1, self.words), -np.inf)
        beta[-1] = 0.0
        for i in range(self.length - 1, -1, -1):
            reach = min(self.length - i, len(self.costs))
            beta[i] = _logsum(np.stack([beta[i + m] + self.costs[m - 1][i] for m in range(1, reach + 1)]))
        return beta

    def expected(self, counts: np.ndarray) -> None:
        """Adds the expected uses of pieces, bytes and word ends to `counts`."""
        alpha, beta = self.forward(), self.backward()
        total = alpha[-1]
        for size, (at, ids) in enumerate(self.edges, start=1):
            i, w = np.divmod(at, self.words)
            share = np.exp(alpha[i, w] + self.costs[size - 1].ravel()[at] + beta[i + size, w] - total[w])
            counts[: len(self.own.pieces)] += np.bincount(ids, share, minlength=len(self.own.pieces))
        i, w = np.divmod(self.bare, self.words)
        share = np.exp(alpha[i, w] + self.costs[0].ravel()[self.bare] + beta[i + 1, w] - total[w])
        for spelling, mass in zip(self.spelling, np.bincount(self.kind, share), strict=True):
            for b in spelling:
                counts[len(self.own.pieces) + b] += mass
        counts[-1] += self.words


def _logsum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=0)
    shift = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return shift + np.log(np.exp(parts - shift).sum(axis=0))


def word_scores(words: list[str], path: str, weights: Weights) -> np.ndarray:
    """Natural-log marginal probability of each word over all its segmentations."""
    own, out = vocabulary(path), np.zeros(len(words))
    for index, codes in _by_length(words):
        out[index] = Lattice(own, weights, codes).forward()[-1] + weights.stop
    return out


def expected_counts(words: list[str], path: str, weights: Weights) -> np.ndarray:
    """Expected uses of pieces, bytes and word ends, one occurrence of each word."""
    own = vocabulary(path)
    counts = np.zeros(len(own.pieces) + 257)
    for _, codes in _by_length(words):
        Lattice(own, weights, codes).expected(counts)
    return counts


_BLOCKS = (
    "block long, id {}, held_out boolean, n_tokens long, numbers array<int>, counts array<int>, "
    "first int, words array<string>, seen array<bigint>"
)


def _blocks(documents: DataFrame) -> DataFrame:
    """(id, text, held_out) as rows of two kinds: documents with their words' numbers, and word lists."""
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        block, known, size = TaskContext.get().partitionId() << 32, {}, 0
        seen = np.zeros(1 << 16, np.int64)

        def word_lists() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for first in range(0, len(words), LIST_WORDS):
                part = words[first : first + LIST_WORDS]
                nothing = {f.name: pa.nulls(1, f.type) for f in schema if f.name in ("id", "held_out", "n_tokens", "numbers", "counts")}
                own = {"block": [block], "first": [first], "words": [part], "seen": [seen[first : first + len(part)]]}
                yield pa.RecordBatch.from_pydict(nothing | own, schema)

        for rows, data, offsets in steps(batches):
            schema = schema or pa.schema(
                [("block", pa.int64()), ("id", rows.schema.field("id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("numbers", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("first", pa.int32()), ("words", pa.list_(pa.string())), ("seen", pa.list_(pa.int64()))]
            )
            low = LOWER[data]
            starts, ends, row = word_spans(low, offsets, NOT_SPACE)
            hashes = span_hashes(prefix_sums(low), starts, ends)
            _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            raw = low.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            while len(seen) < len(known):
                seen = np.concatenate([seen, np.zeros_like(seen)])
            held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            trained = ~held[row]
            seen[: len(known)] += np.bincount(numbers[inverse[trained]], minlength=len(known))[: len(known)]
            pairs, tally = np.unique(row * np.int64(1 << 32) + numbers[inverse], return_counts=True)
            per_row = np.bincount(pairs >> 32, minlength=rows.num_rows)
            none = {f.name: pa.nulls(rows.num_rows, f.type) for f in schema if f.name in ("first", "words", "seen")}
            own = {
                "block": np.full(rows.num_rows, block),
                "id": rows.column("id"),
                "held_out": rows.column("held_out"),
                "n_tokens": np.bincount(row, minlength=rows.num_rows) + 1,
                "numbers": lists(pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), per_row),
                "counts": lists(pa.array(tally.astype(np.int32)), per_row),
            }
            yield pa.RecordBatch.from_pydict(own | none, schema)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from word_lists()
                block, known, size = block + 1, {}, 0
                seen[:] = 0
        if known:
            yield from word_lists()

    return documents.mapInArrow(run, _BLOCKS.format(kind))


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece weights for the words of a table of distinct ones, each counted once.

    Every round runs over all words; the driver gets sums by piece, whose number is the vocabulary's.
    """
    counts = initial_counts(vocabulary(path))
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(counts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, total = Weights(vocabulary(path), shared.value), 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + expected_counts(batch.column(0).to_pylist(), path, weights)
            if not np.isscalar(total):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "n": total[used]})

        sums = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not sums:
            break
        counts = np.zeros(len(counts))
        for row in sums:
            counts[row.piece] = row.n
    return counts


def score(documents: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", *, path: str | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column; rows where it is true teach nothing. Base-10 logarithms. A null or
    empty text is one end. Repeated rows count as often as they stand. Without any training row all
    words are new: N is 0, and so is every known count; scores are those of the lattice alone.
    """
    spark = documents.sparkSession
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    chosen = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = materialize(_blocks(chosen), "blocks")
    ends = blocks.where("words is null").agg(F.count_if(~F.col("held_out"))).first()[0]
    listed = blocks.where("words is not null").select("block", F.posexplode(F.arrays_zip("words", "seen")).alias("k", "w"), "first")
    listed = listed.select("block", (F.col("first") + F.col("k")).alias("number"), F.col("w.words").alias("word"), F.col("w.seen").alias("seen"))
    counted = materialize(listed.groupBy("word").agg(F.sum("seen").alias("c")), "words")
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = totals.n + ends, totals.v + (ends > 0)
    fitted = spark.sparkContext.broadcast(fit(counted.where("c > 0"), path))
    discount = (totals.n1 + 0.5) / (totals.n1 + 2 * totals.n2 + 1)
    new_share = discount * totals.v / n if totals.n else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(vocabulary(path), fitted.value)
        for batch in batches:
            c = batch.column("c").to_numpy()
            lattice = word_scores(batch.column("word").to_pylist(), path, weights) + np.log(new_share)
            with np.errstate(divide="ignore"):
                seen = np.log(np.maximum(c - discount, 0.0) / max(n, 1))
            logs = np.logaddexp(lattice, seen) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs)], ["word", "c", "log"])

    weighed = materialize(counted.mapInArrow(weigh, "word string, c long, log double"), "weights")
    looked_up = listed.select("block", "number", "word").join(weighed, "word").select(F.col("block").alias("home"), "number", "c", "log")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        size = 1 + (int(np.max(right.column("number"))) if right.num_rows else 0)
        number = right.column("number").to_numpy()
        c, log = np.zeros(size, np.int64), np.zeros(size)
        c[number], log[number] = right.column("c").to_numpy(), right.column("log").to_numpy()
        known = c > 0
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        out = {"n_known": [], "base_score": [], "score": []}
        end = (np.log10((ends + 1) / (n + 1 * (v + 1))), np.log10(ends / n) if ends else -np.log10(n + 1.0))
        for batch in left.to_batches():
            counts, at = batch.column("counts"), batch.column("numbers")
            row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
            index, tally = at.flatten().to_numpy(), counts.flatten().to_numpy()
            for name, values, last in (("n_known", known, ends > 0), ("base_score", base, end[0]), ("score", log, end[1])):
                out[name].append(np.bincount(row, values[index] * tally, minlength=len(at)) + last)
        return pa.table(
            {
                "id": left.column("id"),
                "held_out": left.column("held_out"),
                "n_tokens": left.column("n_tokens"),
                "n_known": pa.array(np.concatenate(out["n_known"]).astype(np.int64)),
                "train_tokens": pa.array(np.full(left.num_rows, n, np.int64)),
                "base_score": pa.array(np.concatenate(out["base_score"])),
                "score": pa.array(np.concatenate(out["score"])),
            }
        ) if left.num_rows else _EMPTY.select(range(7)).cast(pa.schema([("id", left.schema.field("id").type), *list(_EMPTY.schema)[1:]]))

    rows = blocks.where("words is null").select("block", "id", "held_out", "n_tokens", "numbers", "counts")
    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.groupBy("block").cogroup(looked_up.groupBy("home")).applyInArrow(add, schema)
    return scored.withColumnRenamed("id", id_column)


_EMPTY = pa.table({"id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def op9_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32 mod 7 is not 2."""
    return score(table(spark, sf_dir, "documents"), bucket_of("doc_id", 7) == 2)
