"""Rules of the JSON lane, one literal per case."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import documents, status
from tidemill.session import require_settings

DOCUMENTS = "source_file string, block bigint, chunk bigint, value string"


@pytest.fixture(autouse=True, params=["true", "false"], ids=["ansi", "lenient"])
def settings(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    require_settings(spark)


def frame(spark, *texts):
    return spark.createDataFrame([(f"f{n}", 0, 0, t) for n, t in enumerate(texts)], DOCUMENTS)


def parse(spark, element):
    return documents.records(frame(spark, f"[{element}]")).first().asDict()


@pytest.mark.parametrize(
    "text, ok",
    [
        ("[]", True), ("[1]", True), (' \n[{"a": 1}]\n', True), ('[{"a": 1, "a": 2}]', True),
        ("{}", False), ('{"a": [1]}', False), ("[1] junk", False), ("[1]] , [", False), ('[1],"z":2', False),
        ("", False), ("[1", False), ("null", False), ('"x"', False), ("[1,]", False), ("[1]\u0000", False),
        ('[{"a": "x\ny"}]', False), ("['a']", False), ("[01]", False), (None, False), ("[1]}", False),
        ('[1],"r":[2]', False),
    ],
)
def test_strict_documents(spark, text, ok):
    assert documents.validate(frame(spark, text)).first()["is_valid"] is ok
    if text is not None:
        try:
            assert isinstance(json.loads(text), list) is ok
        except ValueError:
            assert not ok


@pytest.mark.parametrize(
    "element, expected",
    [
        ('{"venue": null}', {"venue": "None", "city": "", "attendance": 0, "event_date": "1900-01-01"}),
        ('{"venue": true, "city": false}', {"venue": "True", "city": "False"}),
        ('{"venue": "true", "city": 17}', {"venue": "true", "city": "17"}),
        ('{"sport": "S", "sport_type": "T"}', {"sport_type": "S"}),
        ('{"venue": "a", "venue": "b"}', {"venue": "b"}),
        ('{"attendance": 42.7}', {"attendance": 42}),
        ('{"attendance": -42.7}', {"attendance": -42}),
        ('{"attendance": 1e3}', {"attendance": 1000}),
        ('{"attendance": true}', {"attendance": 1}),
        ('{"attendance": "42"}', {"attendance": 42}),
        ('{"attendance": " 1_000 "}', {"attendance": 1000}),
        ('{"attendance": "42.5"}', {"attendance": 0}),
        ('{"attendance": "1,000"}', {"attendance": 0}),
        ('{"attendance": null}', {"attendance": 0}),
        ('{"attendance": [3]}', {"attendance": 0}),
        ('{"event_date": " 2026-04-13 "}', {"event_date": "2026-04-13"}),
        ('{"event_date": null}', {"event_date": "1900-01-01"}),
        ('{"event_date": 1234567890}', {"event_date": "1234567890"}),
        ('{"metadata": {"broadcast": true}}', {"meta_broadcast": "true", "meta_notes": ""}),
        ('{"metadata": {"broadcast": "true"}}', {"meta_broadcast": "false"}),
        ('{"metadata": {"broadcast": 1}}', {"meta_broadcast": "false"}),
        ('{"metadata": {"broadcast": null, "notes": null}}', {"meta_broadcast": "false", "meta_notes": "None"}),
        ('{"metadata": {}}', {"meta_broadcast": "false"}),
        ('{"metadata": null}', {"meta_broadcast": "false", "meta_category": ""}),
        ('{"metadata": [1]}', {"meta_broadcast": "false", "meta_referee": ""}),
        ('{"metadata": "x"}', {"meta_priority": "", "meta_source_system": ""}),
        ('{"metadata.notes": "x", "broadcast": true}', {"meta_notes": "", "meta_broadcast": "false"}),
    ],
)
def test_fields(spark, element, expected):
    row = parse(spark, element)
    assert {k: row[k] for k in expected} == expected


def test_rejects_and_status(spark):
    texts = ['[{"attendance": "x"}, 5, null, "' + "s" * 100 + '"]', "[5]", "[]", '{"a": 1}', '[{"a": 1}']
    docs = frame(spark, *texts)
    previews = {(r["source_file"], r["preview"]) for r in documents.rejects(docs).collect()}
    assert previews == {("f0", "5"), ("f0", "None"), ("f0", "s" * 80), ("f1", "5")}
    rows = {r["source_file"]: tuple(r)[1:] for r in status.file_status(documents.block_summary(docs)).collect()}
    assert rows == {
        "f0": (1, 3, 1, "processed"),
        "f1": (0, 1, 0, "failed"),
        "f2": (0, 0, 0, "failed"),
        "f3": (0, 0, 0, "failed"),
        "f4": (0, 0, 0, "failed"),
    }


def test_a_file_with_one_bad_chunk_loads_nothing(spark):
    docs = spark.createDataFrame([("a", 0, 0, '[{"event_id": "1"}]'), ("a", 5, 1, "[x"), ("b", 0, 0, "[{}]")], DOCUMENTS)
    blocks = documents.block_summary(docs)
    facts = status.block_facts(blocks).where("loads")
    rows = documents.records(docs).join(facts, ["source_file", "block"], "left_semi")
    assert [r["source_file"] for r in rows.collect()] == ["b"]
    assert {r["source_file"]: r["n_valid"] for r in status.file_status(blocks).collect()} == {"a": 0, "b": 1}


def test_document_is_parsed_once_per_use(spark):
    plan = documents.records(frame(spark, "[]"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert "Filter" not in plan


def test_no_python_in_either_lane(spark):
    plan = documents.records(frame(spark, "[]")).select(F.col("venue"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
