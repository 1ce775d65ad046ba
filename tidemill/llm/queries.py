"""Named queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, decontaminate, filter_audit, html_text, lattice, line_rules, near_dup, neighbours, repeats, sharded_lloyd, token_files, toxicity, unit_dedup

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_nearest_neighbours": (neighbours.op1_nearest_neighbours, None),
    "op2_decontamination": (decontaminate.op2_decontamination, decontaminate.OP2_SQL),
    "op3_byte_bpe": (bpe.op3_byte_bpe, None),
    "op4_near_duplicates": (near_dup.op4_near_duplicates, None),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_token_files": (token_files.op6_token_files, None),
    "op7_unit_dedup": (unit_dedup.op7_unit_dedup, unit_dedup.OP7_SQL),
    "op8_suffix_dedup": (repeats.op8_suffix_dedup, None),
    "op9_lattice_score": (lattice.op9_lattice_score, None),
    "op10_html_text": (html_text.op10_html_text, None),
    "op11_sharded_lloyd": (sharded_lloyd.op11_sharded_lloyd, sharded_lloyd.OP11_SQL),
    "op12_line_rules": (line_rules.op12_line_rules, line_rules.OP12_SQL),
    "op13_filter_audit": (filter_audit.op13_filter_audit, filter_audit.OP13_SQL),
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill_package")
        context.addPyFile(shutil.make_archive(archive, "zip", root, "tidemill"))
        _shipped.add(context.applicationId)
