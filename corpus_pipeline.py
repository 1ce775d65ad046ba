"""A training-corpus pipeline: each stage reads what the one before it kept, and writes what it keeps."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemill.llm import bpe, decontaminate, near_dup, toxicity, unit_dedup  # noqa: E402
from tidemill.llm.common import bucket_of, materialize, table  # noqa: E402
from tidemill.llm.queries import ship  # noqa: E402


def _keyed(docs: DataFrame) -> DataFrame:
    """What an operator reads of `docs`: (key, text).

    The key tells rows apart: the id, which may be null or repeated, and the text's hash. Null ids rank last.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("mark"))
    return docs.select(key.alias("key"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` without the rows whose key is in `rejected` (key); the keys are written first, so that their size is known."""
    gone = materialize(rejected.select("key.*").distinct().toDF("__missing", "__id", "__mark"), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark"))
    return docs.join(gone, same, "left_anti")


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`docs` with one row for each of `keys` (key), which have several; the other rows as they are."""
    chosen = docs.join(keys.select("key.*").toDF("__missing", "__id", "__mark").drop("__missing"),
                       F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")))
    return _without(docs, keys).unionByName(chosen.dropDuplicates(["__id", "__mark"]).select(*docs.columns))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; learns from the labels outside the held-out third."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1)
    column = unit_dedup.free_names(["score"], docs.columns)[0]
    scored = toxicity.with_score(docs, toxicity.learn(docs, labels), score_column=column)
    return scored.where(F.col(column) < toxicity.THRESHOLD).drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group alike to 0.8 in five-word shingles, and one row of it.

    Of rows that share that id the smallest text hash stays; rows without an id stay only where their
    group has none with an id. Texts without words are linked with nothing and all stay.
    """
    ship(spark)
    groups = materialize(near_dup.near_duplicates(_keyed(docs), "key", size=5, percent=80), "groups")
    kept = _without(docs, groups.where("not kept"))
    repeated = groups.where("kept and n_shingles > 0").groupBy("key").count().where("count > 1")
    repeated = materialize(repeated.select("key"), "repeated")
    return kept if repeated.isEmpty() else _once(kept, repeated)


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words, wherever lines break, and lines of any length that an earlier document,
    or place, has already; n_chars follows the text."""
    ship(spark)
    passed = materialize(unit_dedup.deduplicate_passages(docs), "passages-out")
    kept = unit_dedup.deduplicate(passed).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row with a benchmark item."""
    ship(spark)
    return _without(docs, decontaminate.report(_keyed(docs), table(spark, sf_dir, "benchmark"), "key").where("contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian unsigned 32-bit) with digests of these and of the decoded bytes.

    This last stage returns these columns only, one row per document; further columns of `docs` end here.
    """
    ship(spark)
    encoded = bpe.encode(docs).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", F.col("ids").alias("coded")
    )
    return bpe.decode(encoded, "coded").select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_units", repeated_units),
    ("decontamination", contaminated_documents),
    ("byte_bpe", token_ids),
]

#: Learned scores and byte-level merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
