"""Operator 3: byte-level BPE encoding and decoding.

The tokenizers library encodes, over Arrow batches. A rank file becomes a tokenizers model: its
bytes are written as printable characters, and every way to put a token together from two others
is a merge, in the order of the ranks. Text is split by the pattern first; the library gets each
distinct piece once per task, for a piece's ids do not depend on what stands around it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import expand, packed, steps, table

#: Distinct pieces that a worker remembers; later ones are encoded again in each step.
REMEMBERED = 200_000

#: Characters that all regular-expression engines class alike. Texts with others are split by the
#: library itself, whose tables of Unicode may be of another year than those of `regex`.
_SETTLED = regex.compile(
    "[^\x00-\x1b\x20-\x7e\xa1-ǿΑ-ΡΣ-ωА-я‐-‧ぁ-んァ-ヶ一-龥가-힣]"
)

#: The pattern of public_tokenizers for texts of these Latin characters, in the faster standard library.
_LATIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-ǿ‐-‧]")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ǿ", "0-9²³¹¼-¾"
_LATIN_SPLIT = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)


@lru_cache
def byte_characters() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in set(printable) else chr(next(spare)) for b in range(256))


@lru_cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache
def load_tokenizer(path: str):
    """A tokenizers.Tokenizer for a .json file, or for a .tiktoken rank file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    if path.endswith(".json"):
        return Tokenizer.from_file(path)
    ranks, names = _ranks(path), byte_characters()
    spelled = {token: "".join(names[b] for b in token) for token in ranks}
    merges = [
        (spelled[token[:cut]], spelled[token[cut:]])
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    vocabulary = {spelled[token]: rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@lru_cache
def byte_strings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens: their concatenation, and each id's start and length."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = load_tokenizer(path).get_vocab()
    by_id = {i: bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name, i in vocabulary.items()}
    size = max(by_id) + 1
    parts = [by_id.get(i, b"") for i in range(size)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Slots(dict):
    """Numbers for pieces in the order they first come."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        self.new.append(piece)
        return slot


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.split = load_tokenizer(path), regex.compile(pattern).findall
        self.standard = pattern == public_tokenizers.PATTERN
        # Tokens the library finds in the text before it splits it; texts with one are left to it as a whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.slots = _Slots()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        """Ids of the pieces that got the last slots."""
        parts = [new[i : i + 2000] for i in range(0, len(new), 2000)]
        for part, found in zip(parts, self.tokenizer.encode_batch(parts, is_pretokenized=True, add_special_tokens=False), strict=True):
            first = len(self.slots) - len(new)
            new = new[len(part) :]
            ids = np.array(found.ids, np.uint32)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
            while len(self.starts) < first + len(part):
                self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
            while len(self.pool) < self.used + len(ids):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.starts[first : first + len(part)] = self.used + np.cumsum(counts) - counts
            self.counts[first : first + len(part)] = counts
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        number, used, slots = self.slots.__getitem__, self.used, []
        for text in texts:
            if self.added(text):
                slots.append(None)
                continue
            if not self.standard:
                pieces = self.split(text)
            elif not _LATIN.search(text):
                pieces = _LATIN_SPLIT.findall(text)
            elif not _SETTLED.search(text):
                pieces = self.split(text)
            else:
                slots.append(None)
                continue
            slots.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        new, self.slots.new = self.slots.new, []
        self._learn(new)
        out = [
            np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            if slot is None
            else self.pool[expand(self.starts[slot], self.counts[slot])]
            for text, slot in zip(texts, slots, strict=True)
        ]
        if len(self.slots) > REMEMBERED:
            self.used = used
            for piece in new:
                del self.slots[piece]
        return out


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder per worker process, so that tasks after the first find it filled."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, pattern)
    return _encoders[key]


def character_starts(text: str, counts: np.ndarray) -> np.ndarray:
    """The character in which each token begins, given the tokens' byte lengths."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[np.cumsum(counts) - counts] if len(counts) else np.zeros(0, np.int64)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, path: str | None = None,
           pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """(id, ids) and, if asked for, character offsets of the tokens, one row per document.

    ids: the token ids as little-endian unsigned 32-bit integers. offsets: for each token the
    character it begins in; tokens that split a character share that character's number. A null
    text counts as empty and has no ids. Repeated rows are encoded each for itself; other columns
    than the two named are not read. Texts are never cut.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for rows, data, ends in steps(batches, "text"):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            found = own.encode(texts)
            out = {"id": rows.column("id"), "ids": pa.array([x.tobytes() for x in found], pa.binary())}
            if offsets:
                lengths = byte_strings(path)[2]
                starts = [character_starts(t, lengths[x]) for t, x in zip(texts, found, strict=True)]
                out["offsets"] = pa.array([x.astype(np.int32) for x in starts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    chosen = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, ids binary" + ", offsets array<int>" * offsets
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ids_column: str = "ids", *, path: str | None = None) -> DataFrame:
    """`encoded` with `decoded` (binary, the exact bytes) instead of its ids column.

    Null ids decode to no bytes. The bytes need not be whole characters: ids that end within one
    keep its first bytes. `decoded_text` reads them as text.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rest = [c for c in encoded.columns if c != ids_column]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, starts, lengths = byte_strings(path)
        for rows, data, ends in steps(batches, ids_column):
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            counts = lengths[ids]
            text = pool[expand(starts[ids], counts)].tobytes()
            cuts = np.concatenate([[0], np.cumsum(counts)])[ends // 4]
            pieces = [text[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(pieces, pa.binary())], [*rest, "decoded"])

    return encoded.mapInArrow(run, schema)


def decoded_text(data: bytes) -> str:
    """Decoded bytes as text; a character whose bytes are not all there becomes U+FFFD."""
    return data.decode("utf-8", errors="replace")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    encoded = encode(table(spark, sf_dir, "documents"))
    digests = encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )
    return decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
