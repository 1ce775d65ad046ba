"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

from collections import Counter

import pytest
from compare import difference

import corpus_pipeline
from tidemill.llm import bpe, decontaminate, near_dup, queries, toxicity, unit_dedup
from tidemill.llm.common import bucket_of, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_query_matches_sql(spark, name):
    assert difference(spark, SF_DIR, name) is None


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "test")
        if name != "byte_bpe":
            assert out.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.learn(docs, table(spark, SF_DIR, "labels").where(bucket_of("doc_id", 3) != 1))
            assert kept == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
        if name == "near_duplicates":
            groups = near_dup.near_duplicates(docs, size=5).collect()
            assert kept == {r.component_id for r in groups} and len(kept) < len(ids)
            assert near_dup.near_duplicates(out, size=5).where("not kept").isEmpty()
        if name == "repeated_units":
            assert kept == ids and unit_dedup.repeated_units(out).isEmpty()
            assert out.where("n_chars != char_length(text)").isEmpty()
        if name == "decontamination":
            report = decontaminate.report(docs, table(spark, SF_DIR, "benchmark")).collect()
            assert kept == {r.doc_id for r in report if not r.contaminated}
        if name == "byte_bpe":
            assert kept == ids
            texts = {r.doc_id: r.text or "" for r in docs.collect()}
            assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(out.select("doc_id", "ids")).collect()} == texts
        docs = out


def test_pipeline_takes_out_short_repeated_lines(spark):
    queries.ship(spark)
    rows = [(1, "All rights reserved\nfirst\n\nlast"), (2, "second\nall rights  reserved\n\nlast"), (3, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_units(spark, docs, SF_DIR).collect()}
    assert out == {1: rows[0][1], 2: "second\n", 3: ""}


def test_pipeline_takes_out_repeated_passages_that_lines_break_differently(spark):
    queries.ship(spark)
    passage, longer = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(80)]
    rows = [(1, "first " + " ".join(passage)), (2, "its own\n" + "\n".join(" ".join(passage[k : k + 7]) for k in range(0, 60, 7)) + " end"), (3, " ".join(longer)), (4, " ".join(longer[:49]) + " else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_units(spark, docs, SF_DIR).collect()}
    assert out == dict(rows) | {2: "its own\nend"}


AWKWARD = "doc_id long, text string, source string, score double, kept boolean, removed string, n_units int, mark long, `key` string"


def _awkward(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0.5, True, "r", n, 1, "k") for n, (i, t) in enumerate(rows)], AWKWARD)


def test_pipeline_stages_lose_no_unrelated_row(spark):
    """Null and repeated ids: a rejected row takes no other with it, and of equal rows one stays."""
    queries.ship(spark)
    copy, other, third = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, copy), (None, copy), (None, other), (7, copy), (5, third), (7, other + " end"), (5, third), (8, None), (8, None), (9, "")]
    docs = _awkward(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    assert left == Counter([(1, copy), (5, third), (7, other + " end"), (8, None), (8, None), (9, "")])
    benchmark = table(spark, SF_DIR, "benchmark").where("length(text) > 100").first().text
    rows = [(1, benchmark), (1, copy), (None, benchmark), (None, other), (2, None), (2, "")]
    out = corpus_pipeline.contaminated_documents(spark, _awkward(spark, rows), SF_DIR)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, copy), (None, other), (2, None), (2, "")])


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (3, ""), (3, "x " * 30_000)]])
def test_pipeline_stages_take_empty_tables_and_odd_rows(spark, rows):
    queries.ship(spark)
    docs = _awkward(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.count() == len(rows)
        assert name == "byte_bpe" or out.columns == docs.columns
