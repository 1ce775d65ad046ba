"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tidemill.llm import filter_audit, line_rules, queries, sharded_lloyd

WORDS = ["alpha", "Beta", "gamma", "délta", "EPS", "zeta!", "|", "•", "$x", "end.", "NEWS", "cookie", "ÑLL!!"]


@pytest.fixture(autouse=True)
def shipped(spark):
    queries.ship(spark)


# --- 11 ------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dimension):
    """Plain Python integers, one row after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        label = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, label, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()), tuple(centroids[c])) for i, c, d in found)


def vectors(spark, rows):
    full = [(v, i, 1, "x", 0.5) for i, v in rows]
    return spark.createDataFrame(full, "embedding array<float>, vec_id long, chunk int, cluster string, distance double")


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_sharded_lloyd_is_plain_lloyd(spark, shards):
    rng = random.Random(shards)
    rows = [(i, [round(rng.gauss(i % 5, 0.3), 2) for _ in range(6)]) for i in range(300)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += rows[:20]  # equal rows
    rows += [(7, [9.0] * 6), (None, rows[3][1]), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7)]
    rows += [(504, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (505, [math.nan] * 6), (506, [math.inf] * 6), (507, [-0.0] * 6)]
    found = sharded_lloyd.cluster(vectors(spark, rows), k=4, rounds=5, shards=shards, dimension=6).collect()
    assert Counter((*r[:5], tuple(r.centroid)) for r in found) == lloyd(rows, 4, 5, 6)


def test_sharded_lloyd_ties_few_rows_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]
    found = sharded_lloyd.cluster(vectors(spark, rows), dimension=2).collect()
    assert Counter((*r[:5], tuple(r.centroid)) for r in found) == lloyd(rows, 8, 10, 2)
    none = sharded_lloyd.cluster(vectors(spark, [(1, None), (None, [1.0])]), dimension=2)
    assert none.isEmpty() and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sharded_lloyd.cluster(vectors(spark, [(None, [1.0, 2.0])]), dimension=2).isEmpty()


def test_sharded_lloyd_reads_vectors_without_shuffling_them(spark):
    """Where labels are too large to broadcast, a shard's blocks are joined as they lie in their buckets."""
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(5000)]
    plain = vectors(spark, rows).selectExpr("vec_id AS id", "embedding AS vector")
    name, _ = sharded_lloyd._bucketed(sharded_lloyd.pack(plain, 2, 2), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.table(name)
        labels = spark.createDataFrame([(0, [1])], "chunk long, cluster array<int>")
        joined = chunks.select("chunk", "b0").join(labels, "chunk")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
        spark.sql(f"DROP TABLE {name}")


def test_narrow_integers_come_back():
    for top in (3, 40_000, 1 << 40):
        x = np.array([[-top, top], [0, 1], [top, 2]])
        assert (sharded_lloyd._wide(sharded_lloyd._narrow(x), 3, 2) == x).all()
    with pytest.raises(ValueError, match="too large"):
        sharded_lloyd._integers(np.array([1e30]))


# --- 12 ------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def rule_of(line):
    w = words_of(line)
    n = len(w)
    if not n:
        return None
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    separators = sum(x in line_rules.SEPARATORS for x in w)
    symbols = sum(any(c in line_rules.SYMBOLS for c in x) for x in w)
    shouted = sum(sum("A" <= c <= "Z" for c in x) >= 2 and not any("a" <= c <= "z" for c in x) for x in w)
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    if separators >= 2 and 100 * separators >= 20 * n:
        return "navigation"
    if n >= 3 and 100 * symbols > 30 * n:
        return "symbols"
    if n >= 3 and 2 * shouted > n:
        return "shouting"
    if n >= 4 and 2 * same > n:
        return "repetition"
    if n <= 30 and any(p in low for p in line_rules.PHRASES):
        return "boilerplate"
    return None if w[-1].endswith(line_rules.ENDS) else "punctuation"


def cleaned(text):
    plain = text or ""
    lines, w = plain.split("\n"), words_of(plain)
    rules = [rule_of(x) for x in lines]
    spans, at = [], 0
    for k, (line, rule) in enumerate(zip(lines, rules, strict=True)):
        size = len(line.encode())
        if rule:
            spans.append((k, at, at + size, rule))
        at += size + 1
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in lines if words_of(x)]
    lost = sum(len(words_of(x)) for x, rule in zip(lines, rules, strict=True) if rule)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    left = "\n".join(x for x, rule in zip(lines, rules, strict=True) if not rule)
    symbols = sum(c in line_rules.SYMBOLS for c in plain)
    counts = (len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), len(again), lost)
    return (left if text is not None else None, tuple(spans), *counts, failed, not failed and 100 * lost <= 40 * len(w))


def random_text(rng):
    lines = []
    for _ in range(rng.randint(1, 8)):
        few = rng.sample(WORDS, rng.randint(1, len(WORDS)))
        line = rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\x0b"]).join(rng.choice(few) for _ in range(rng.randint(0, 30)))
        lines.append(line + rng.choice(["", ".", "。", "”", " ", "\r", "!"]))
    return "\n".join(lines + rng.sample(lines, rng.randint(0, 1)))


def test_line_rules_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n a", "x" * 5000, "a b c " * 20_000 + "end.", "Cook", "ie here.", "privacy ", "policy.", "\x00  x.", "😀 done."]
    texts += [random_text(rng) for _ in range(300)] + [" ".join(f"word{i}" for i in range(60)) + "."]
    rows = [(t, None if i % 50 == 3 else i // 2, "x", 1, True, "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:30], "text string, doc_id long, id string, n_words int, kept boolean, removed string, rule string").coalesce(2)
    found = Counter((r[0], r[1], tuple(tuple(x) for x in r[2]), *r[3:]) for r in line_rules.clean(docs).collect())
    assert found == Counter((r[1], *cleaned(r[0])) for r in rows + rows[:30])
    assert any(r[-1] for r in found) and len({x[3] for r in found for x in r[2]}) == len(line_rules.RULES)


def test_line_rules_of_no_documents(spark):
    assert line_rules.clean(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_line_rules_separate_labelled_junk(spark):
    """Of labelled documents whose base doesn't fail, quality decides as the labels do."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = line_rules.clean(docs).where("not base_failed").withColumnRenamed("id", "doc_id").join(labels.where("toxic = 0"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert set(counts) == {(1, True), (0, False)}


# --- 13 ------------------------------------------------------------------------------


def failing(text):
    w = words_of(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * capitals > 5 * len(text), any(c in "#$%&*|" for c in text))


def audited(rows, labels):
    """Applies the filters one after the other, document by document."""
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, part, text in rows:
        text = text or ""
        copy = i is not None and i > first[text]
        marks = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", dict(zip("ABCDE", (*failing(text), copy), strict=True)), any(q == 1 for _, q, _ in marks), any(t == 1 for _, _, t in marks)))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley, made = [d for d in docs if d[0] == part], Counter(), {}
        for order in map("".join, permutations("ABCDE")):
            rest, gone = own, []
            for step, f in enumerate(order, 1):
                removed, rest = [d for d in rest if d[1][f]], [d for d in rest if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                made[part, order, step] = (len(rest), len(removed), sum(d[1][f] for d in gone), alone, sum(d[2] for d in removed), sum(d[3] for d in removed))
                shapley[f] += len(removed)
                gone = gone + removed
        out |= {key: (*value, shapley[key[1][key[2] - 1]]) for key, value in made.items()}
    return out


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(9)
    pool = [None, "", "a" * 4000, "Same Same " * 40, "x # y"] + [" ".join(rng.choice(["a", "Bc", "d$", "é", *map(str, range(60))]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = [(None if i % 17 == 5 else i % 90, rng.choice(["s", "t", None, ""]), rng.choice(pool)) for i in range(120)]
    rows += rows[:10]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, source string, text string, part string, good boolean")
    marks = spark.createDataFrame([(*x, "id") for x in labels], "doc_id long, quality int, toxic int, id string")
    found = filter_audit.audit(filter_audit.contingency(filter_audit.judged(docs, marks), {f: f for f in "ABCDE"})).collect()
    assert len(found) == 600 * 3
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in found} == audited(rows, labels)


def test_filter_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    names = {f: f for f in "ABCDE"}
    assert filter_audit.audit(filter_audit.contingency(filter_audit.judged(docs, labels), names)).isEmpty()
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    found = filter_audit.audit(filter_audit.contingency(filter_audit.judged(one, labels), names)).collect()
    assert {(r.part, r.kept, r.removed) for r in found if r.step == 5} == {("", 0, 0), ("", 0, 1)}
    assert {r.shapley for r in found} == {120, 0}


def test_shapley_shares_out_what_all_filters_remove(spark):
    rows = spark.createDataFrame([("p", True, True, False), ("p", False, True, None), ("p", False, False, False)], "part string, x boolean, y boolean, z boolean").selectExpr("*", "true AS good", "false AS toxic")
    found = filter_audit.audit(filter_audit.contingency(rows, {"X": "x", "Y": "y", "Z": "z"}), "XYZ").collect()
    assert {(r.filter_order[r.step - 1], r.shapley) for r in found} == {("X", 3), ("Y", 9), ("Z", 0)}
