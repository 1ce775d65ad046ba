"""The operators against brute force on small tables with nulls, empty texts, copies and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from tidemill.llm import (
    bpe,
    decontaminate,
    html_text,
    lattice,
    near_dup,
    neighbours,
    queries,
    repeats,
    token_files,
    toxicity,
    unit_dedup,
)
from tidemill.session import scratch_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, mark int, row string, n int, label int"


@pytest.fixture(autouse=True)
def shipped(spark):
    queries.ship(spark)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 9)) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(4)]
    texts = [None, "", "one", "a b c", "x" * 3000, "ab " * 900, "中文 text 😀 '\x1c\x85 end", base[0], base[0], base[1]]
    for b in base:
        words = b.split()
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
            texts.append(" ".join(copy))
        texts.append(sentence(rng, 30) + "\n" + b + "\n" + sentence(rng, 40))
        texts.append(sentence(rng, 15) + " " + " ".join(words[20:80]) + " " + sentence(rng, 15))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA).repartition(3)


def test_bpe_equals_tiktoken_and_decodes(spark):
    rows = documents()
    own = {r.doc_id: r for r in bpe.encode(frame(spark, rows), offsets=True).collect()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in rows:
        ids = np.frombuffer(own[i].ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(text or "")
        raw, at = [reference.decode_single_token_bytes(t) for t in ids], 0
        for token, start in zip(raw, own[i].offsets, strict=True):
            before = (text or "").encode()[:at]
            split = at < len((text or "").encode()) and (text or "").encode()[at] & 0xC0 == 0x80
            assert start == len(before.decode(errors="ignore")) - 0 * split
            at += len(token)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(frame(spark, rows))).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    assert bpe.decoded_text("é".encode()[:1]) == "�"


def test_piece_memory_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, tokenizer = bpe.PieceEncoder(path, public_tokenizers.PATTERN), bpe.load_tokenizer(path)
    for _, text in documents() * 2:
        assert small.encode([text or ""])[0].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    rows = documents() + [(900, "a <|endoftext|> b"), (901, "<|endoftext|><|endoftext|>"), (902, "x" * 200_000 + " <|endof text|>")]
    folder = scratch_dir(spark, "tokens")
    manifest = token_files.write_token_files(frame(spark, rows), folder)
    found = {r.doc_id: r for r in token_files.read_token_files(manifest, folder, ids=True).collect()}
    tokenizer, start = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids) == (start, len(ids), ids)
        assert found[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("size", [1 << 21, 3])
def test_token_files_null_and_repeated_ids(spark, monkeypatch, size):
    rows = [(5, "five five"), (None, "none at all"), (5, "five five"), (5, "other five"), (None, None), (-3, "minus")]
    folder = scratch_dir(spark, "tokens")
    monkeypatch.setattr(token_files, "RANGE_IDS", size)
    manifest = token_files.write_token_files(frame(spark, rows), folder, shards=2)
    found = sorted(token_files.read_token_files(manifest, folder, ids=True).collect(), key=lambda r: r.start)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [(-(1 << 63) if i is None else i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows]
    assert [r.doc_id for r in found] == sorted(i for i, _ in expected)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter(expected)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()


def test_shards_follow_the_bytes(spark, monkeypatch):
    docs = frame(spark, [(i, "x" * 1000) for i in range(50)] + [(99, None)])
    assert token_files.shard_count(docs, "text") == 1
    monkeypatch.setattr(token_files, "SHARD_BYTES", 500)
    assert token_files.shard_count(docs, "text") == 100


def test_own_pattern_holds_for_all_characters():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.PieceEncoder(path, r"\S+|\s+")
    single = [own.encode([p])[0].tolist() for p in ("don't\u2c7b", " ", "a1")]
    assert own.encode(["don't\u2c7b a1"])[0].tolist() == sum(single, [])


def test_decontamination_short_items_and_copies(spark):
    rng = random.Random(2)
    rows = documents()
    long_item = " ".join(rows[7][1].split()[5:40])
    items = [(1, long_item), (2, long_item.upper()), (3, "ONE"), (4, None), (5, "..."), (6, sentence(rng, 12)), (7, "ab " * 30), (8, "b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = {r.doc_id: r for r in decontaminate.report(frame(spark, rows), bench).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows:
        words, hit, names = word.findall((text or "").translate(LOWER)), set(), set()
        for name, item in items:
            other = word.findall((item or "").translate(LOWER))
            n = min(10, len(other))
            windows = {tuple(other[k : k + n]) for k in range(len(other) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (own[i].n_words, own[i].n_hit, own[i].n_items, own[i].items_sha256) == (len(words), len(hit), len(names), digest)


def brute_components(rows, size, percent):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = documents()
    template = sentence(rng, 60).split()
    for _ in range(25):  # variants of one text, alike to about the threshold
        copy = list(template)
        for at in rng.sample(range(60), 2):
            copy[at] = str(rng.random())
        rows.append((len(rows), " ".join(copy)))
    own = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows), size=4).collect()}
    assert own == brute_components(rows, 4, 80)


def test_near_duplicates_of_many_variants(spark):
    rng = random.Random(10)
    template = [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(110)]
    texts = [" ".join(template)]
    for _ in range(170):  # words changed, put in and taken out, some places often; linked with the template, with each other, or with none
        copy = list(texts[-1].split()) if rng.random() < 0.15 else list(template)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            at = rng.choice([rng.randrange(len(copy)), 7, 40])
            copy[at : at + rng.randint(0, 1)] = rng.choice([[], ["new" + str(rng.randint(0, 9))], [str(rng.random())]])
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    for first in (0, 1):  # with the template and without it
        own = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows[first:]), size=4).collect()}
        assert own == brute_components(rows[first:], 4, 80)


def test_collision_correction():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    sketch = near_dup.registers(np.concatenate([x, y]), np.array([900, 900]))
    found = near_dup.estimate(sketch[:1], sketch[1:], np.array([900]), np.array([900]))[0]
    assert abs(found - 0.8) < 0.15
    assert near_dup.collision_rate(np.array([1000.0]), np.array([1000.0]))[0] < 0.01


def brute_repeats(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), runs, bytes(c for c, x in zip(t, gone, strict=True) if not x)


@pytest.mark.parametrize("paired", [repeats.PAIRED, 0])
def test_repeated_strings(spark, monkeypatch, paired):
    monkeypatch.setattr(repeats, "PAIRED", paired)
    rows = documents()
    own = {r.doc_id: r for r in repeats.deduplicate_bytes(frame(spark, rows)).collect()}
    for (i, _), expected in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200), strict=True):
        assert (own[i].n_bytes, own[i].n_removed, len(own[i].removed), bytes(own[i].kept)) == expected


def test_unit_dedup_keeps_the_first_and_says_where(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(3, f"{line}\nshort\n{line.upper()} "), (1, f"head\n{line}"), (2, None), (4, ""), (5, f"  {line}\nshort")]
    own = {r.doc_id: r for r in unit_dedup.deduplicate(frame(spark, rows)).collect()}
    assert {i: own[i].text for i in own} == {3: "short", 1: f"head\n{line}", 2: None, 4: "", 5: ""}
    assert [(s.place, s.start, s.end) for s in own[3].removed] == [(0, 0, len(line)), (2, len(line) + 7, 2 * len(line) + 8)]
    paragraphs = [(1, f"{line}\n\nx"), (2, f"y\n \n{line}\n\nz")]
    own = {r.doc_id: r.text for r in unit_dedup.deduplicate(frame(spark, paragraphs), unit="paragraph").collect()}
    assert own == {1: f"{line}\n\nx", 2: "y\n\nz"}


def _later_passages(rows, words):
    """The words of each row that stand in a passage with an earlier place, by brute force."""
    firsts, out = {}, {}
    for i, text in sorted(rows):
        plain = text.translate(unit_dedup._CAPITALS).split()
        gone = set()
        for k in range(len(plain) - words + 1):
            head = firsts.setdefault(tuple(plain[k : k + words]), (i, k))
            if head[0] != i or k - head[1] >= words:
                gone |= set(range(k, k + words))
        out[i] = gone
    return out


def test_passages_are_found_wherever_lines_break(spark):
    """Random texts put together from shared pieces and broken anywhere, against brute force."""
    random.seed(11)
    vocabulary = [f"{c}{k}" for k in range(40) for c in "aBé"]
    pieces = [[random.choice(vocabulary) for _ in range(random.randint(3, 40))] for _ in range(12)]
    rows = [(90, "same " * 70), (91, "one two " * 40), (92, "same " * 9), (93, ""), (94, " \n")]
    for i in range(80):
        words = [w for _ in range(random.randint(1, 6)) for w in random.choice(pieces)[random.randint(0, 5) :]]
        words = [w.upper() if w.isascii() and random.random() < 0.2 else w for w in words]
        rows.append((i, "".join(w + random.choice([" ", " ", "\n", "\t", " \n\n"]) for w in words)))
    for words in (2, 9, 10):
        found = unit_dedup.repeated_passages(frame(spark, rows), words=words).collect()
        want = {(i, k) for i, gone in _later_passages(rows, words).items() for k in gone}
        assert {(r.id, k) for r in found for k in range(r.first, r.last)} == want and want
        out = {r.doc_id: r.text for r in unit_dedup.deduplicate_passages(frame(spark, rows), words=words).collect()}
        assert out.keys() == dict(rows).keys()
        for i, text in rows:
            gone = {k for j, k in want if j == i}
            assert out[i].split() == [w for k, w in enumerate(text.split()) if k not in gone]
            assert gone or out[i] == text


def test_passages_null_and_repeated_ids_and_other_columns(spark):
    passage, other = (" ".join(f"{x}{k}" for k in range(50)) for x in "pq")
    rows = [(None, passage, 1), (1, f"before {passage.upper()}\nbehind", 2), (1, f"x\n{passage.replace(' ', chr(10))} y", 3), (2, None, 4), (2, passage, 5), (2, passage, 6), (3, other, 7), (3, other, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Cuts int")
    out = unit_dedup.deduplicate_passages(docs)
    assert out.columns == docs.columns
    texts = {r.Cuts: r.text for r in out.collect()}
    assert texts == {1: passage, 2: "before\nbehind", 3: "x\ny", 4: None, 5: "", 6: "", 7: other, 8: other}
    assert unit_dedup.deduplicate_passages(docs.limit(0)).isEmpty()


def test_unit_dedup_null_and_repeated_ids_long_texts_and_clashing_names(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(2, "a\nb", 1, "r"), (2, "a\nb", 2, "s"), (2, "b\nc", 3, None), (None, "a\nd", 4, "t"), (7, long, 5, "u"), (8, "x\nline 19999", 6, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_units int, removed string")
    out = unit_dedup.deduplicate(docs)
    assert out.columns == ["doc_id", "text", "N_units", "removed", "n_units_", "removed_"]
    texts = {r.N_units: r.text for r in out.collect()}
    # A null id ranks first; rows of equal id and text are one document; of one id the text hash decides.
    assert texts[4] == "a\nd" and texts[5] == long and texts[6] == "x"
    assert texts[1] == texts[2] and {texts[1], texts[3]} in ({"b", "c"}, {"", "b\nc"})


def test_lattice_marginal_is_the_sum_over_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = lattice.vocabulary(path)
    words = ["the", "theable", "中文", "a😀b", "é", "x" * 40, "thinging"]
    weights = lattice.Weights(own, lattice.expected_counts(words, path, lattice.Weights(own, lattice.initial_counts(own))))
    logs = {p: weights.pieces[k] for k, p in enumerate(own.pieces) if own.start[k] > 0}

    def total(word):
        sums = [1.0]
        for j in range(1, len(word) + 1):
            here = sum(sums[i] * math.exp(logs[word[i:j]]) for i in range(j) if word[i:j] in logs and not (i and word[i] == "▁"))
            if word[j - 1 : j] not in logs:
                here += sums[j - 1] * math.exp(sum(weights.bytes[b] for b in word[j - 1].encode()))
            sums.append(here)
        return math.log(sums[-1]) + weights.stop

    assert np.allclose(lattice.word_scores(words, path, weights), [total("▁" + w) for w in words])


def test_lattice_scores(spark):
    rows = documents()
    own = {r.doc_id: r for r in lattice.score(frame(spark, rows), F.col("doc_id") % 7 == 2).collect()}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter(w for i in tokens if i % 7 != 2 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in words)
        assert (own[i].n_tokens, own[i].n_known, own[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert own[i].base_score == pytest.approx(base) and own[i].score < 0 and math.isfinite(own[i].score)


def test_lattice_scores_against_brute_force(spark):
    """Every step in plain Python: counts, two rounds of expectation maximisation, forward sums, discounts."""
    own = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(0, "the cat The cat sat"), (1, "the theable 😀b dog"), (2, "a theable unseenword cat"), (3, None), (5, "中文 dog dog"), (9, "the newest"), (None, "the " * 40)]
    held_out = F.col("doc_id") % 7 == 2
    tokens = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))) for i, t in rows]
    held = [i is not None and i % 7 == 2 for i, _ in tokens]
    counts = Counter(w for (_, words), h in zip(tokens, held, strict=True) if not h for w in words)
    ends = held.count(False)
    n = sum(counts.values()) + ends
    index = {p: k for k, p in enumerate(own.pieces) if own.start[k] > 0}

    def paths(word, weights):
        """All segmentations of a word: their pieces and byte values, and log weight."""
        word = "▁" + word
        out = {0: [((), 0.0)]}
        for j in range(1, len(word) + 1):
            out[j] = []
            for i in range(j):
                part = word[i:j]
                if part in index and not (i and part[0] == "▁"):
                    step, cost = (index[part],), weights.pieces[index[part]]
                elif j - i == 1 and part not in index:
                    step = tuple(len(own.pieces) + b for b in part.encode())
                    cost = sum(weights.bytes[b] for b in part.encode())
                else:
                    continue
                out[j] += [(used + step, log + cost) for used, log in out[i]]
        return out[len(word)]

    weights = lattice.Weights(own, lattice.initial_counts(own))
    for _ in range(lattice.ROUNDS):
        expected = np.zeros(len(own.pieces) + 257)
        for word in counts:  # each distinct word once, as the lattice gives the mass of new words
            ways = paths(word, weights)
            whole = sum(math.exp(log) for _, log in ways)
            for used, log in ways:
                np.add.at(expected, list(used), math.exp(log) / whole)
            expected[-1] += 1
        weights = lattice.Weights(own, expected)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = (once + 0.5) / (once + 2 * twice + 1)

    def log10(word):
        marginal = sum(math.exp(log) for _, log in paths(word, weights)) * math.exp(weights.stop)
        return math.log10(max(counts[word] - discount, 0) / n + discount * len(counts) / n * marginal)

    wanted = [(i, sum(map(log10, words)) + math.log10(ends / n)) for i, words in tokens]
    found = {r.doc_id: r.score for r in lattice.score(frame(spark, rows), held_out).collect()}
    assert found == pytest.approx(dict(wanted), rel=1e-6)


def test_lattice_scores_of_repeated_rows_long_texts_and_no_training(spark):
    long = "word " * 60_000 + "y" * 20_000
    rows = [(1, long), (1, long), (1, "word"), (None, ""), (None, None)]
    scored = lattice.score(frame(spark, rows), F.col("doc_id") == 8).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in scored) == [(0, 1), (0, 1), (1, 2), (1, 60_002), (1, 60_002)]
    assert len({(r.n_tokens, r.score) for r in scored}) == 3
    untrained = lattice.score(frame(spark, rows), F.lit(True)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(math.isfinite(r.score) and r.n_known == 0 for r in untrained)


def brute_features(text, lexicon, exceptions):
    """By the docstring: at each place where a word begins the longest entry counts, unless a phrase that begins a word covers it."""
    text = toxicity.fold(text)
    begins = [k for k in range(len(text)) if k == 0 or not text[k - 1].isalnum()]
    excused = [(k, k + len(e)) for k in begins for e in exceptions if text.startswith(e, k)]
    times = Counter()
    for k in begins:
        open_ = [e for e in lexicon if text.startswith(e, k) and not any(a <= k and k + len(e) <= b for a, b in excused)]
        if open_:
            times[max(open_, key=len)] += 1
    return sum(lexicon[e] * (1 + math.log(c)) for e, c in times.items())


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(11)
    lexicon = {"ab": 1.0, "abba": 2.5, "moro": 3.0, "c c": 0.5}
    exceptions = ("ab bb", "the moron", "abbaa")
    model = toxicity.Model(lexicon, exceptions, (1.5, 0.25, 2.0, -3.0))
    parts = ["ab", "abba", "Abbaa", "m0r0n", "the", "bb", "c", "xab", "мого", "ａbba", "z-ab", "a\u200bbba", "\n", "!", ""]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(300)]
    rows += [(300, None), (300, ""), (None, "abba"), (None, "abba"), (301, "ab " * 50_000)]
    found = sorted(((r.doc_id is None, r.doc_id, r.score) for r in toxicity.score(frame(spark, rows), model).collect()), key=str)
    wanted = []
    for i, text in rows:
        text = text or ""
        weight = brute_features(text, lexicon, exceptions)
        words = text.count(" ") + text.count("\n") + 1
        z = 1.5 * math.log1p(weight) + 0.25 * weight / math.sqrt(words) + 2 * min(weight / words, 1) - 3
        wanted.append((i is None, i, 1 / (1 + math.exp(-max(-30, min(30, z))))))
    for (_, i, own), (_, j, right) in zip(found, sorted(wanted, key=str), strict=True):
        assert i == j and own == pytest.approx(right)
    with pytest.raises(ValueError, match="exists already"):
        toxicity.with_score(frame(spark, rows).withColumn("score", F.lit(1)), model)


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        # The word harms by itself; in a test's name it doesn't.
        told = f"{rng.choice(['you', 'such', 'what'])} {'moron' if k % 2 else 'person'}"
        rows.append((k, f"{sentence(rng, 12)} {'the moron test' if k % 20 == 0 else told} {sentence(rng, 12)}"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, rows), labels)
    assert {"the moron", "moron test"} <= set(model.exceptions) and "moron" in {e[:5] for e in model.lexicon}
    asked = [(0, "take the moron test"), (1, "you moron"), (2, "the moron test says moron")]
    own = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(frame(spark, asked), model).collect()}
    assert own == {0: False, 1: True, 2: True}


def test_toxicity_folds_and_excuses(spark):
    rng = random.Random(3)
    insults = ["idiot", "moron", "trash"]
    rows = [(k, sentence(rng, 20) + (f" {insults[k % 3]} " if k % 2 else " ") + sentence(rng, 20)) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, rows), labels)
    asked = [(0, "you 1d1оt"), (1, "a tr​ash heap"), (2, "the trash can"), (3, None), (4, "fine words"), (5, "MORON!")]
    own = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(frame(spark, asked), model).collect()}
    assert own == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}
    empty = toxicity.learn(frame(spark, rows), labels.where("false"))
    assert {r.score for r in toxicity.score(frame(spark, asked), empty).collect()} == {0.0}


def test_html_text(spark):
    notice = "We keep small files on your machine so that this site can remember what you like best of all the things here"
    pages = [(k, f"http://h.example/{k}", f"<html><head><title>t</title></head><body><div><p>{notice}</p><p>Own text {k} of page &amp; more {k}{f' word{k}' * 30}<br>end.</p></div></body>") for k in range(4)]
    pages += [(10, None, None), (11, "http://x.example", ""), (12, "http://x.example", "<p>cut <b>off"), (13, "http://y.example", "<article><p>A<aside>no</aside><p>B</article><section class='comments'><p>c</p></section>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    own = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert own == {**{k: f"Own text {k} of page & more {k}{f' word{k}' * 30} end." for k in range(4)}, 10: "", 11: "", 12: "cut off", 13: "A\n\nB"}


def test_html_text_repeated_blocks_anywhere(spark):
    rng = random.Random(12)
    for size in (20, 35, 80):
        middle, items, end = sentence(rng, size), [sentence(rng, 7) for _ in range(4)], sentence(rng, size)
        own = {k: (sentence(rng, 150), sentence(rng, 150)) for k in range(6)}
        menu = "".join(f"<li>{x}</li>" for x in items)
        pages = [(k, f"http://h.example/{k}", f"<body><p>{a}</p><p>{middle}</p><p>{b}</p><ul>{menu}</ul><p>{end}</p></body>") for k, (a, b) in own.items()]
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == {k: f"{a}\n\n{b}" for k, (a, b) in own.items()}


def html_pages(spark, pages):
    """Main texts of pages given by id as host and blocks."""
    rows = [(k, f"http://{host}/{k}", "<body>" + "".join(f"<p>{b}</p>" for b in texts)) for k, (host, *texts) in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n\n") for r in html_text.main_text(df).collect()}


def test_html_text_counts_distinct_pages(spark):
    rng = random.Random(13)
    frames, two, notice, article = [sentence(rng, 40) for _ in range(5)], sentence(rng, 40), sentence(rng, 25), sentence(rng, 120)
    own = {k: sentence(rng, 120) for k in range(24)}
    pages = {k: ("big.example", own[k], frames[k % 5]) for k in range(20)}  # five templates, none on half of the pages
    pages |= {k: ("two.example", own[k], two) for k in (20, 21)}
    pages |= {k: ("copies.example", article) for k in (30, 31, 32, 33)}  # one page four times
    pages |= {k: ("copies.example", own[k], notice) for k in (22, 23)} | {34: ("copies.example", article, notice)}
    expected = {k: [own[k]] for k in range(24)} | {k: [article] for k in range(30, 35)}
    assert html_pages(spark, pages) == expected


def test_html_text_short_notices_go_and_articles_stay(spark):
    rng = random.Random(16)
    notice, shared, own = sentence(rng, 12), sentence(rng, 40), {k: sentence(rng, 60) for k in range(16)}
    bare = {k: ("n.example", own[k], notice) for k in range(8)}
    assert html_pages(spark, bare) == {k: [own[k]] for k in range(8)}
    rows = [(k, f"http://n.example/{k}", f"<body><div>{notice}</div><article><p>{own[k]}</p><p>{shared}</p></article><div>{notice}</div></body>") for k in range(8, 16)]
    rows += rows[:2] + [(None, "http://n.example/n", f"<p>{own[0]}</p><p>{notice}</p>"), (99, None, "<main><p>" + "long words " * 50_000 + "</p></main>")]
    rows += [(k, f"http://n.example/{k}", f"<p>{b}</p><p>{c}</p>") for k, (_, b, c) in bare.items() if k]
    found = html_text.main_text(spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, parts string, bare boolean")).collect()
    expected = Counter({(k, f"{own[k]}\n\n{shared}"): 1 + (k < 10) for k in range(8, 16)})
    expected += Counter([(None, own[0]), (99, ("long words " * 50_000).strip()), *((k, own[k]) for k in range(1, 8))])
    assert Counter((r.page_id, r.text) for r in found) == expected


def test_html_text_is_what_the_markup_leaves_where_pages_have_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = {r.page_id: html_text._chosen(html_text.blocks(r.html or "")) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == plain


def test_html_text_short_articles_in_long_frames(spark):
    rng = random.Random(14)
    footer, notice, article = sentence(rng, 60), sentence(rng, 40), sentence(rng, 80)
    own = {k: sentence(rng, 60 if k < 4 else 8) for k in range(8)}
    pages = {k: ("short.example" if k < 4 else "shorter.example", own[k], footer, notice) for k in own}
    pages |= {k: ("copies.example", f"Read {k} times", article, notice) for k in (10, 11, 12)}  # copies but for a counter
    pages |= {k: ("copies.example", sentence(rng, 60), notice) for k in range(20, 25)}
    expected = {k: [own[k]] for k in own} | {k: [f"Read {k} times", article] for k in (10, 11, 12)} | {k: [pages[k][1]] for k in range(20, 25)}
    assert html_pages(spark, pages) == expected


def test_html_text_tells_pages_apart_by_the_whole_digest(spark):
    rng = random.Random(15)
    footer, own = sentence(rng, 40), []
    while len(own) < 3:  # digests alike in their last five bits
        text = sentence(rng, 40)
        if html_text.hash_text(f"{text}\n\n{footer}") % 32 == 7:
            own.append(text)
    assert html_pages(spark, {k: ("h.example", t, footer) for k, t in enumerate(own)}) == {k: [t] for k, t in enumerate(own)}


def test_html_text_shared_substrings_meet_whatever_stands_around_them(spark):
    rng = random.Random(17)
    parts, own = [sentence(rng, 30) for _ in range(6)], {k: sentence(rng, 60) for k in range(15)}
    pairs = [(a, b) for a in range(6) for b in range(a)]  # no two footers are alike, each part is on five
    pages = {k: ("h.example", own[k], f"{parts[a]} {parts[b]}") for k, (a, b) in enumerate(pairs)}
    assert html_pages(spark, pages) == {k: [t] for k, t in own.items()}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:160] = x[7]
    rows = [(k, x[k].tolist()) for k in range(1500)] + [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [float("nan")] * 16), (2400, [1.0, None] * 8), (2500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    found = neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and np.allclose([s for _, _, s in own], d[[v for _, v, _ in own]])
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert {r.query_id for r in found} == set(range(0, 1500, 100)) and hits >= 0.9 * 150


def test_nearest_neighbours_infinite_components_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [4.0, 0.0]), (2, [3.0, 0.0]), (3, [float("inf"), 0.0]), (4, [0.0, float("-inf")]), (None, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest_neighbours(df, F.lit(True)).collect()
    # The first vector in order stands for the id; rows with infinite components or no id take no part.
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_neighbour_graph_rounds_end_and_lists_hold_no_pair_twice(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 12)) * 4
    x = (centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 12))).astype(np.float32)
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>")
    graph = {r.id: [(n.d, n.other) for n in r.near] for r in neighbours.build_graph(nodes).collect()}
    assert set(graph) == set(range(3000))
    hits = 0
    for k, near in graph.items():
        others = [o for _, o in near]
        assert k not in others and len(set(others)) == len(others) <= neighbours.DEGREE and near == sorted(near)
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(others))
    assert hits >= 0.95 * 10 * 3000


def test_nearest_neighbours_signs_of_zero(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest_neighbours(df, F.col("vec_id") < 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(1, 1, 2, 0.0), (1, 2, 3, 2.0), (2, 1, 1, 0.0), (2, 2, 3, 2.0)]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert decontaminate.report(none, bench).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert repeats.deduplicate_bytes(none).count() == 0
    assert unit_dedup.deduplicate(none).count() == 0
    assert lattice.score(none, F.lit(False)).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    folder = scratch_dir(spark, "tokens")
    assert token_files.read_token_files(token_files.write_token_files(none, folder), folder).count() == 0
    assert neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
