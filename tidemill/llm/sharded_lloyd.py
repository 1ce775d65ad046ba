"""Operator 11: Lloyd's clustering with the dimensions dealt out to shards.

Vectors become rows of integers, packed into chunks of rows and, within a chunk, into one column block
per shard. The table of chunks is written once, bucketed by chunk, a column for each block: a shard's
tasks read their own block alone. A round has two jobs:

* each shard's tasks work out exact partial distances of their blocks to their slices of the centroids;
  a reduction by chunk adds the blocks and takes the argmin, which gives one label per row;
* each shard joins the labels with its blocks, by bucket, sums its components per cluster in the tasks
  and updates its slice.

Shuffled are partial distances (in the narrowest integers that hold them) and labels, never vectors.
Between rounds only the centroids come to the driver: k x dimension integers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, scratch_dir, table

CLUSTERS, ROUNDS, SHARDS, DIMENSION = 8, 10, 2, 64
SCALE = 1024
#: With components of up to 2^27, squared distances over 64 of them fit into 64 bits.
LARGEST = 1 << 27
CHUNK_VALUES = 1 << 18
BUCKET_BYTES = 128 << 20


def sound(vector: str, dimension: int) -> Column:
    """Whether a vector has exactly `dimension` components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def _integers(flat: np.ndarray) -> np.ndarray:
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE} makes squared distances too large for 64 bits")
    return scaled.astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """As the narrowest of int16, int32 and int64 that holds all; the length says which."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind).tobytes()
    return values.astype(np.int64).tobytes()


def _wide(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // max(1, rows * width)]
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.int64)


def _blocks(dimension: int, shards: int) -> list[slice]:
    edges = np.linspace(0, dimension, shards + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def pack(rows: DataFrame, dimension: int, shards: int) -> DataFrame:
    """(chunk, n, ids, b0, b1, ...) of (id, vector): integers, row by row within each block."""
    blocks = _blocks(dimension, shards)
    size = max(1, CHUNK_VALUES // dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                values = _integers(flat).reshape(part.num_rows, dimension)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                data = [pa.array([_narrow(values[:, b])], pa.binary()) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([part.num_rows], pa.int32()), ids, *data], ["chunk", "n", "ids", *[f"b{i}" for i in range(shards)]]
                )
                chunk += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"chunk long, n int, ids array<{kind}>, " + ", ".join(f"b{i} binary" for i in range(shards)))


def _bucketed(chunks: DataFrame, n_bytes: int) -> tuple[str, str]:
    """Writes `chunks` in buckets by chunk, as a table over a shared folder: the table's name and the folder."""
    spark = chunks.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    path = scratch_dir(spark, "chunks")
    name = "tidemill_" + path.rsplit("-", 1)[-1]
    dealt = chunks.repartition(buckets, "chunk")
    dealt.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", path).format("parquet").saveAsTable(name)
    return name, path


def partial_distances(chunks: DataFrame, centroids: np.ndarray, shards: int) -> DataFrame:
    """(chunk, n, part): of every shard, exact squared distances of its block's rows to its slices."""
    k, dimension = centroids.shape

    def of(block: slice):
        own = centroids[:, block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    x = _wide(data, n, own.shape[1])
                    d = np.empty((n, k), np.int64)
                    for c in range(k):
                        away = x - own[c]
                        d[:, c] = (away * away).sum(1)
                    out.append(_narrow(d))
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array(out, pa.binary())], ["chunk", "n", "part"])

        return run

    parts = [
        chunks.select("chunk", "n", F.col(f"b{i}").alias("data")).mapInArrow(of(block), "chunk long, n int, part binary")
        for i, block in enumerate(_blocks(dimension, shards))
    ]
    return reduce(DataFrame.unionByName, parts)


def assign(chunks: DataFrame, centroids: np.ndarray, shards: int) -> DataFrame:
    """(chunk, n, cluster, distance): arrays over the chunk's rows; the nearest, ties to the smaller number."""
    k = len(centroids)

    def add(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        total = sum(_wide(part, n, k) for part in group.column("part").to_pylist())
        best = total.argmin(1)
        ends = pa.array([0, n], pa.int32())
        return pa.table(
            {
                "chunk": group.column("chunk").slice(0, 1),
                "n": group.column("n").slice(0, 1),
                "cluster": pa.ListArray.from_arrays(ends, pa.array(best.astype(np.int32))),
                "distance": pa.ListArray.from_arrays(ends, pa.array(total[np.arange(n), best])),
            }
        )

    columns = "chunk long, n int, cluster array<int>, distance array<long>"
    return partial_distances(chunks, centroids, shards).groupBy("chunk").applyInArrow(add, columns)


def updated(chunks: DataFrame, labels: DataFrame, centroids: np.ndarray, shards: int) -> np.ndarray:
    """Every shard's new slices, floor(sum / count) by cluster and component; empty clusters keep theirs."""
    k, dimension = centroids.shape

    def of(block: slice):
        width = block.stop - block.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                clusters = batch.column("cluster")
                for i, (n, data) in enumerate(zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True)):
                    x, own = _wide(data, n, width), clusters[i].values.to_numpy()
                    for c in np.unique(own):
                        sums[c] += x[own == c].sum(0)
                    counts += np.bincount(own, minlength=k)
            filled = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(filled, width), pa.int64()),
                    pa.array(np.tile(np.arange(block.start, block.stop), len(filled)), pa.int64()),
                    pa.array(sums[filled].ravel()),
                    pa.array(np.repeat(counts[filled], width)),
                ],
                ["cluster", "component", "total", "members"],
            )

        return run

    parts = []
    for i, block in enumerate(_blocks(dimension, shards)):
        joined = chunks.select("chunk", "n", F.col(f"b{i}").alias("data")).join(labels.select("chunk", "cluster"), "chunk")
        parts.append(joined.select("n", "data", "cluster").mapInArrow(of(block), "cluster long, component long, total long, members long"))
    total, members = F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")
    found = reduce(DataFrame.unionByName, parts).groupBy("cluster", "component").agg(total, members)
    out = centroids.copy()
    for row in found.collect():  # k x dimension rows
        out[row["cluster"], row["component"]] = int(row["total"]) // row["members"]
    return out


def seeds(rows: DataFrame, k: int, salt: str) -> DataFrame:
    """The k rows (id, vector) whose ids have the smallest sha256 of salt and id, in that order.

    Null ids are none; rows of one id follow each other by their vectors, and equal rows are several seeds.
    """
    return rows.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256), "vector").limit(k)


def cluster(
    table_: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    *,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    shards: int = SHARDS,
    dimension: int = DIMENSION,
    salt: str = "3:",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every sound vector after `rounds` rounds.

    Components are floor(1024 * x). `centroid` is the array of the final centroid's integers. Rows that
    are equal or share an id are clustered one by one, a null id like any other (but it seeds nothing).
    Vectors that are null, of another length or hold null or non-finite components take no part. With
    fewer than k ids there are as many centroids; without any, no rows. Rounds that would change nothing
    are not run. A component beyond 131,072 either way ends the job with an error: distances would not
    fit into a long. Other columns are not read, so their names can't clash.
    """
    spark = table_.sparkSession
    plain = table_.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(sound("vector", dimension))
    counted = Observation()
    first = seeds(plain.observe(counted, F.count(F.lit(1)).alias("rows")), k, salt).collect()  # k rows
    kind = plain.schema["id"].dataType.simpleString()
    columns = "id, cluster, distance, cluster_inertia, inertia, centroid"
    if not first:
        empty = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], empty)
    centroids = np.stack([_integers(np.array(row["vector"], np.float64)) for row in first])
    name, path = _bucketed(pack(plain, dimension, shards), counted.get["rows"] * dimension * 2)
    chunks = spark.table(name)
    for _ in range(rounds):
        labels = materialize(assign(chunks, centroids, shards).select("chunk", "cluster"), "labels")
        moved = updated(chunks, labels, centroids, shards)
        if (moved == centroids).all():
            break
        centroids = moved
    final = materialize(assign(chunks, centroids, shards).drop("n"), "assigned")
    ids = spark.read.schema(chunks.schema).parquet(path).select("chunk", "ids")
    spark.sql(f"DROP TABLE {name}")  # its files stay; what is returned reads them by path
    pairs = final.select(F.explode(F.arrays_zip("cluster", "distance")).alias("x")).select("x.*")
    sums = {r["cluster"]: int(r["s"]) for r in pairs.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    each = [F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]
    places = [F.array(*[F.lit(v).cast("long") for v in c.tolist()]) for c in centroids]
    whole = ids.join(final, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("x"))
    out = whole.select(F.col("x.ids").alias("id"), F.col("x.cluster").alias("cluster"), F.col("x.distance").alias("distance"))
    out = out.withColumns(
        {
            "cluster_inertia": F.get(F.array(*each), F.col("cluster")),
            "inertia": F.lit(sum(sums.values())).cast("long"),
            "centroid": F.get(F.array(*places), F.col("cluster")),
        }
    )
    return out.select(*columns.split(", "))


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all 64-dimensional embeddings after ten rounds."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM
    (SELECT r, c, list_sum(list_transform(range(1, {DIMENSION + 1}), lambda j: (q[j] - m[j]) * (q[j] - m[j])))::BIGINT AS d FROM v, c{i})) WHERE place = 1),
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {DIMENSION + 1})) AS j, unnest(q) AS x FROM v JOIN a{i} USING (r)) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(u.m, c{i}.m) AS m FROM c{i} LEFT JOIN
    (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c) u USING (c)),"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q AS m FROM v WHERE vec_id IS NOT NULL
    QUALIFY c < {CLUSTERS}),{"".join(_round_sql(i) for i in range(ROUNDS))}
f AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM
    (SELECT r, c, list_sum(list_transform(range(1, {DIMENSION + 1}), lambda j: (q[j] - m[j]) * (q[j] - m[j])))::BIGINT AS d FROM v, c{ROUNDS})) WHERE place = 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c{ROUNDS} USING (c)
"""
