"""Large JSON arrays cut into small ones: same records and verdicts as reading them whole."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import arraysplit, documents
from tidemill.operators.arraysplit import split_arrays
from tidemill.sources.files import read_documents, read_pieces

VALID = {
    "plain": json.dumps([{"event_id": f"E{i}", "metadata": {"notes": "n"}} for i in range(40)], indent=2),
    "dense": json.dumps([{"event_id": f"E{i}"} for i in range(40)], separators=(",", ":")),
    "tricky": json.dumps(
        [{"event_id": 'a"}]', "venue": "\\"}, {"event_id": "{[\"\\\\\"", "city": "}{][,"}, {"event_id": "é}"}]
    ),
    "mixed": '[5, "x}", {"event_id": "A"}, [1, {"b": 2}], null, {"event_id": "B", "metadata": {"x": [{"y": {}}]}}, 7 ]',
    "nested": '[[{"a":1},{"b":2}], {"event_id":"C"}]',
    "scalars": "[1, 2, 3]",
    "empty": "[]",
    "spaced": ' \n[ {"event_id": "D"} \n , \t{"event_id": "E"} ] \n',
}
BROKEN = {
    "object": '{"a": {"b": 1}, "c": [{"d": 2}]}',
    "truncated": '[{"event_id": "A"}, {"event_id": "B"}',
    "cut_in_string": '[{"event_id": "A"}, {"event_id": "B',
    "trailing": '[{"event_id": "A"}] x',
    "trailing_brace": '[{"event_id": "A"}]}',
    "two_arrays": '[{"event_id": "A"}] , [{"event_id": "B"}]',
    "inner_break": '[{"event_id": "A"}, 5] , [6, {"event_id": "B"}]',
    "double_comma": '[{"event_id": "A"},, {"event_id": "B"}]',
    "last_comma": '[{"event_id": "A"}, ]',
    "no_comma": '[{"event_id": "A"} {"event_id": "B"}]',
    "bad_escape": '[{"event_id": "A\\}"}, {"event_id": "B"}]',
    "extra_key": '[{"a":1}[5],"x":{"c":3}]',
    "nothing": " ",
    "number": "5",
    "unclosed": '[[[{"a":1},{"b":2}]',
}


@pytest.fixture(params=[None, 64], ids=["one_block", "many_blocks"])
def splits(spark, request):
    """Also with files cut into blocks of 64 bytes."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _write(folder, texts):
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    return str(folder)


def _accepted(text):
    try:
        return isinstance(json.loads(text), list)
    except ValueError:
        return False


def test_same_verdict_as_a_whole_read(spark, splits, tmp_path):
    texts = {**VALID, **BROKEN}
    assert all(_accepted(t) for t in VALID.values()) and not any(_accepted(t) for t in BROKEN.values())
    chunks = split_arrays(read_pieces(spark, _write(tmp_path, texts), "*.json"))
    verdicts = (
        documents.validate(chunks).groupBy("source_file").agg(F.bool_and("is_valid").alias("ok")).collect()
    )
    assert {r["source_file"][:-5]: r["ok"] for r in verdicts} == {n: n in VALID for n in texts}


def test_same_records_as_a_whole_read(spark, splits, tmp_path):
    folder = _write(tmp_path, VALID)
    found = [(f"{folder}/{n}.json", 1) for n in VALID]
    whole = documents.records(read_documents(spark, found)).drop("block")
    split = documents.records(read_documents(spark, found, whole_limit=0)).drop("block")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    rejects = documents.rejects(read_documents(spark, found, whole_limit=0))
    assert sorted(map(tuple, rejects.collect())) == sorted(
        map(tuple, documents.rejects(read_documents(spark, found)).collect())
    )


def test_random_damage_gets_the_verdict_of_a_strict_parser(spark, splits, tmp_path):
    rng = random.Random(11)
    base = json.dumps([{"event_id": 'q"}', "metadata": {"notes": "\\{["}}, 5, {"event_id": "z"}, [{"a": []}]])
    texts = {}
    for number in range(60):
        text = base
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "}", "{", "]", "[", '"', ",", "\\", " "]) + text[at + rng.randint(0, 1) :]
        texts[f"t{number}"] = text
    chunks = split_arrays(read_pieces(spark, _write(tmp_path, texts), "*.json"))
    rows = documents.validate(chunks).groupBy("source_file").agg(F.bool_and("is_valid").alias("ok")).collect()
    assert {r["source_file"][:-5]: r["ok"] for r in rows} == {n: _accepted(t) for n, t in texts.items()}


def test_a_file_without_element_ends_is_not_gathered(spark, tmp_path, splits):
    texts = {"endless": '{"a": [' + ", ".join(['{"b": 1}'] * 200) + "]}", "fine": VALID["plain"]}
    pieces = read_pieces(spark, _write(tmp_path, texts), "*.json")
    rows = split_arrays(pieces, max_group_bytes=1000).collect()
    endless = [r for r in rows if r["source_file"] == "endless.json"]
    assert len(endless) == 1 and endless[0]["value"] is None
    assert sum(r["source_file"] == "fine.json" for r in rows) > 40


def test_only_numbers_cross_the_profile_shuffle_and_text_crosses_one(spark, splits, tmp_path):
    pieces = read_pieces(spark, _write(tmp_path, VALID), "*.json")

    def exchanged(df):
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(([^)]*)\)", text)

    found = exchanged(arraysplit._block_profiles(pieces))
    assert found and not any("value#" in columns for columns, _ in found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanged(split_arrays(pieces))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    by = {re.sub(r"#\d+L?", "", keys) for columns, keys in found if "value#" in columns or "text#" in columns}
    assert by == {"source_file, block, 8"}  # and what stands at block ends, collected by group
