"""Plans that must hold when nothing is small any more."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemill.operators import documents, labeled, ledger, status
from tidemill.plans import load
from tidemill.queries import files as queries
from tidemill.session import default_setting, materialize, scratch_dir
from tidemill.sources import files

LINES = "source_file string, block bigint, line_no bigint, value string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def lines(spark, rows=3000):
    """One file holds a third of all lines, spread over many blocks like any large file."""
    hot = F.col("id") % 3 == 0
    header = F.col("id").isin(1, 2, 30)
    return spark.range(rows).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string"))).alias("source_file"),
        F.floor(F.col("id") / 100).alias("block"),
        F.col("id").alias("line_no"),
        F.when(header, F.concat(F.lit("##INGEST_METADATA## ingest_ts=t"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("Event ID: E"), F.col("id").cast("string")))
        .alias("value"),
    )


def attached(spark):
    classified = labeled.classify(lines(spark))
    facts = status.block_facts(materialize(labeled.block_summary(classified), "blocks"))
    return status.attach_ingest_ts(labeled.records(classified), facts)


def expected_ts(row):
    n = int(row["event_id"][1:])
    source = "hot" if n % 3 == 0 else f"f{n % 50}"
    return {"hot": "t30", "f1": "t1", "f2": "t2"}.get(source, "unknown")


def test_facts_are_broadcast_only_while_small(spark):
    assert "BroadcastHashJoin" in plan(attached(spark))
    assert all(r["ingest_ts"] == expected_ts(r) for r in attached(spark).collect())


def test_the_header_scan_takes_no_line_apart(spark):
    text = plan(labeled.block_headers(lines(spark)))
    assert "split(" not in text and "transform(" not in text
    facts = status.block_facts(materialize(labeled.block_headers(lines(spark)), "blocks"))
    rows = status.attach_ingest_ts(labeled.records(labeled.classify(lines(spark))), facts)
    assert all(r["ingest_ts"] == expected_ts(r) for r in rows.collect())


def test_beyond_the_limit_the_join_goes_by_block(spark, no_broadcast):
    text = plan(attached(spark))
    assert "BroadcastHashJoin" not in text
    join = next(row for row in text.split("\n") if "SortMergeJoin" in row)
    assert "source_file" in join and "block" in join
    rows = attached(spark).collect()
    assert len(rows) == 2997 and all(r["ingest_ts"] == expected_ts(r) for r in rows)


def test_ledger_joins_without_broadcast(spark, no_broadcast):
    names = spark.range(100).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("source_file"))
    known = names.where("source_file like 'f1%'")
    assert ledger.unseen(names, known).count() == 89
    assert ledger.seen(names, known).count() == 11


def test_no_python_and_no_cross_join(spark):
    text = plan(attached(spark)) + plan(labeled.rejects(labeled.classify(lines(spark))))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_one_column_of_a_record_needs_no_other(spark):
    text = plan(labeled.records(labeled.classify(lines(spark))).select("sport_type"))
    assert "Sport" in text and "Team A" not in text


def test_labels_are_worked_out_once(spark):
    text = plan(labeled.records(labeled.classify(lines(spark))))
    assert text.count("substring_index") == 2  # one for either way of trimming


def test_listing_leaves_contents_unread(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    text = plan(files.list_files(spark, str(tmp_path), "*.txt"))
    assert "ReadSchema: struct<path:string,length:bigint>" in text


def test_documents_spread_over_files(spark, tmp_path):
    for n in range(20):
        (tmp_path / f"{n}.json").write_text('[{"event_id": "E"}]')
    found = [(str(p), 1) for p in tmp_path.glob("*.json")]
    frame = files.read_documents(spark, found)
    assert frame.rdd.getNumPartitions() > 1
    assert documents.records(frame).count() == 20


@pytest.fixture
def made(spark, tmp_path, monkeypatch):
    """Folders that the queries make in this test, by purpose."""
    monkeypatch.setattr(queries, "scratch_dir", lambda _, purpose: str(tmp_path / purpose))
    return tmp_path


def write_events(spark, folder, rows):
    moment, number = F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000), F.col("id")
    events = spark.range(rows).select(
        number.alias("event_id"), moment.alias("ts"), (number % 7).alias("user_id"), F.lit("goal").alias("event_type"),
        (number % 120).cast("double").alias("value"), F.lit('{"a": 1}').alias("props"),
    )
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_raw_preview_makes_no_file_per_document(spark, made):
    found = queries.raw_preview_json(spark, write_events(spark, made / "given", 1000)).collect()
    assert [r.raw_line for r in found] == ["  114,", "  137,", "  160,"]
    assert len(list((made / "raw").glob("part-*"))) <= 8  # of 50 documents
    lines = Counter(r.value for r in spark.read.text(str(made / "raw")).collect())
    queries._write_documents(queries.event_documents(spark, str(made / "given")), str(made / "each"))
    assert lines == Counter(r.value for r in spark.read.text(str(made / "each")).collect())


def test_split_files_are_cut_up_and_parsed_once(spark, made):
    rows = queries.json_files_split(spark, write_events(spark, made / "given", 2500))
    assert rows.count() == sum(k % 23 != 22 for k in range(2500) if k // 500 not in (1, 2, 3))
    assert "Scan text" not in plan(rows) and "parse_json" not in plan(rows)


def test_parsed_lines_give_what_classified_lines_give(spark):
    frame = lines(spark)
    classified, parsed = labeled.classify(frame), materialize(labeled.parsed(frame), "parsed")
    pairs = [(getattr(labeled, n)(classified), getattr(labeled, f"parsed_{n.removeprefix('block_')}")(parsed)) for n in ("block_summary", "records", "rejects")]
    for old, new in pairs:
        assert old.columns == new.columns
        assert Counter(old.collect()) == Counter(new.collect())


def loaded(spark, folder, names):
    """Plans of what the passes of a load of some files get, and the load's table."""
    plans, text = [], "Event ID: E1 | Status: F\nno record\nEvent ID: E2 | Attendance: x\n"
    for name in names:
        (folder / name).write_text(text)

    def seen(step):
        return lambda frame, **keep: plans.append(plan(frame)) or step(frame, **keep)

    lane = replace(load.TEXT, **{n: seen(getattr(load.TEXT, n)) for n in ("summarize", "records", "rejects")})
    table, base = queries._new_table(spark)
    store = load.Store(f"{base}/state")
    load.load_directory(spark, str(folder), lane, table, store, "2026-04-01 00:00:00")
    assert spark.table(table).count() == 2 * len(names) and store.rejects(spark).count() == len(names)
    return plans


def test_a_load_takes_lines_apart_once(spark, tmp_path):
    plans = loaded(spark, tmp_path, ["a.txt", "b.txt"])
    assert len(plans) == 3 and not any("Scan text" in p for p in plans)


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
    copy = materialize(spark.range(3).toDF("n"), "copy")
    assert copy.inputFiles()[0].replace("file:", "").lstrip("/").startswith(shared.lstrip("/"))


def test_a_default_setting_gives_way_to_the_session(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = spark.conf.get(key)
    with default_setting(spark, key, "5m"):
        assert spark.conf.get(key) == "5m"
    assert spark.conf.get(key) == usual
    spark.conf.set(key, "3m")
    try:
        with default_setting(spark, key, "5m"):
            assert spark.conf.get(key) == "3m"
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)


def test_a_load_reads_underscored_files_once(spark, tmp_path):
    plans = loaded(spark, tmp_path, ["_a.txt", "b.txt"])
    assert len(plans) == 3 and not any("BatchScan" in p for p in plans)
