"""The ledger on disk: runs of merged rows, bucketed by name, and one small delta per mark.

A pointer file names the runs that count and the deltas they have taken in; all other deltas count
beside them. Merging writes a new run and then the next pointer, so readers see the one state or the
other, and whoever loses a race for a pointer leaves the state alone. Runs grow geometrically, like
their number of buckets: after any history there are a few runs, and of each a batch of names reads
only the buckets these names fall into.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import ledger
from tidemill.sources import paths

#: Deltas that may stand beside the runs before they are merged.
MOST_DELTAS = 16
#: A merge takes in runs of up to so many times the rows it has gathered so far.
GROWTH = 4
BUCKET_ROWS, MOST_BUCKETS = 100_000, 4096

_RUN_SCHEMA = ledger.SCHEMA + ", bucket int"


def bucket_of(buckets: int):
    """The bucket of a source_file; numbers of buckets are powers of two, so that they nest."""
    return F.pmod(F.xxhash64("source_file"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class State:
    """What one pointer says."""

    version: int = 0
    runs: tuple[tuple[str, int, int], ...] = ()  # name, rows, buckets
    folded: frozenset[str] = frozenset()  # deltas that are part of the runs
    trash: tuple[str, ...] = ()  # folders that the pointer before this one still needed

    def text(self) -> str:
        return json.dumps({"runs": self.runs, "folded": sorted(self.folded), "trash": self.trash})


class LedgerFiles:
    """Ledger rows (stage, source_file, ts, run_id) under a folder that all executors reach."""

    def __init__(self, root: str):
        self.root = root

    def state(self, spark: SparkSession) -> State:
        names = [n for n in paths.names_in(spark, f"{self.root}/pointers") if n.isdigit()]
        if not names:
            return State()
        found = json.loads(paths.read_text(spark, f"{self.root}/pointers/{max(names)}"))
        return State(int(max(names)), tuple(map(tuple, found["runs"])), frozenset(found["folded"]), tuple(found["trash"]))

    def deltas(self, spark: SparkSession, state: State) -> list[str]:
        """Complete deltas that no run has taken in."""
        names = [n for n in paths.names_in(spark, f"{self.root}/deltas") if n not in state.folded]
        return [n for n in names if paths.exists(spark, f"{self.root}/deltas/{n}/_SUCCESS")]

    def append(self, rows: DataFrame) -> None:
        """One more delta, of as few files as its rows need."""
        rows.select(*_columns()).hint("rebalance").write.parquet(f"{self.root}/deltas/{uuid.uuid4().hex}")

    def read(self, spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
        """All rows; with `names` (source_file) at least those of these names, from their buckets only."""
        state = self.state(spark)
        parts = [spark.createDataFrame([], ledger.SCHEMA)]
        if live := self.deltas(spark, state):
            parts.append(spark.read.schema(ledger.SCHEMA).parquet(*[f"{self.root}/deltas/{n}" for n in live]))
        most = max((buckets for _, _, buckets in state.runs), default=1)
        wanted = None
        if names is not None and most > 1:
            found = names.select(bucket_of(most).alias("b")).distinct().collect()  # MOST_BUCKETS at most
            wanted = {row["b"] for row in found}
        for name, _, buckets in state.runs:
            run = spark.read.schema(_RUN_SCHEMA).parquet(f"{self.root}/runs/{name}")
            if wanted is not None and len(own := {b % buckets for b in wanted}) < buckets:
                run = run.where(F.col("bucket").isin(sorted(own)))
            parts.append(run.select(*_columns()))
        return reduce(DataFrame.unionByName, parts)

    def merge(self, spark: SparkSession, most: int = MOST_DELTAS) -> bool:
        """Put the deltas into a run, if there are more than `most`; True if that is now the state.

        Of several rows of a file and stage the latest stays. What the merge replaces is deleted by
        the next one, when nobody reads it any more.
        """
        state = self.state(spark)
        live = self.deltas(spark, state)
        if len(live) <= most:
            return False
        rows = spark.read.schema(ledger.SCHEMA).parquet(*[f"{self.root}/deltas/{n}" for n in live])
        count, taken = rows.count(), []
        for name, size, _ in sorted(state.runs, key=lambda run: run[1]):
            if size > GROWTH * count:
                break
            taken.append(name)
            count += size
            rows = rows.unionByName(spark.read.schema(_RUN_SCHEMA).parquet(f"{self.root}/runs/{name}").drop("bucket"))
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < count:
            buckets *= 2
        latest = F.max(F.struct("ts", "run_id")).alias("last")
        merged = rows.groupBy("stage", "source_file").agg(latest).select("stage", "source_file", "last.ts", "last.run_id")
        name = uuid.uuid4().hex
        path = f"{self.root}/runs/{name}"
        laid_out = merged.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "stage", "source_file")
        laid_out.write.partitionBy("bucket").parquet(path)
        kept = tuple(run for run in state.runs if run[0] not in taken)
        size = spark.read.schema(_RUN_SCHEMA).parquet(path).count()
        trash = (*(f"deltas/{n}" for n in live), *(f"runs/{n}" for n in taken))
        # Deltas stay listed as folded until their folders are gone.
        after = State(state.version + 1, (*kept, (name, size, buckets)), frozenset(live), trash)
        for old in state.trash:
            paths.remove(spark, f"{self.root}/{old}")
        if not paths.put_new(spark, f"{self.root}/pointers/{after.version:012d}", after.text()):
            paths.remove(spark, path)  # someone else has merged meanwhile
            return False
        if state.version > 1:
            paths.remove(spark, f"{self.root}/pointers/{state.version - 1:012d}")
        return True


def _columns() -> list[str]:
    return [field.split()[0] for field in ledger.SCHEMA.split(", ")]
