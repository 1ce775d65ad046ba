"""Operator 1: approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct vector is a node. A first graph comes from a few random projections: nodes in the
order of their signs' pattern are cut into blocks of equal size, and each finds its nearest in its
block. Then each round of NN-descent joins the graph with the vectors, compares the neighbours of a
node with each other where one of the two is new to its list, and lets every node keep the nearest it
has seen. Rounds go on until one changes fewer than a small share of all list entries (CHANGED).
A query starts at its own node; each round joins the nearest candidates not yet opened with the graph,
in both directions, and stops when the best of them are all open.

Blocks and neighbour lists have fixed sizes, so no task depends on how vectors cluster, and a pair is
only shuffled to a node whose list it betters. Copies of a vector beyond the first k + 1 cannot be
among anyone's k nearest by the order of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, table

PROJECTIONS = 6
BLOCK = 512
DEGREE = 32
#: NN-descent ends with a round that changes a smaller share of all list entries.
CHANGED = 0.1
#: Candidates that a search keeps, and those it opens in a round.
BEAM = 256
OPENED = 128


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of the last but one axis."""
    norm = (x * x).sum(-1)
    return np.maximum(norm[..., :, None] + norm[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), 0)


def _keyed(nodes: DataFrame, dimension: int) -> DataFrame:
    """Nodes by projection, with the sign pattern of 24 random axes, as a walk along a tree of half-spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [np.random.default_rng(1000 + n).standard_normal((dimension, 24)).astype(np.float32) for n in range(PROJECTIONS)]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                for number in range(PROJECTIONS):
                    bits = (x @ axes[number] > 0).astype(np.int64)
                    key = pa.array((bits << np.arange(23, -1, -1)).sum(1))
                    yield batch.append_column("number", pa.array(np.full(len(x), number, np.int32))).append_column("key", key)

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(run, f"id long, vector {kind}, number int, key long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of BLOCK consecutive nodes of one projection; the last block takes what is left over."""
    ids, rows, current = np.zeros(0, np.int64), None, None
    for batch in batches:
        numbers, every, x = batch.column("number").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("vector"))
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for first, last in zip(cuts, cuts[1:]):
            if first == last:
                continue
            if numbers[first] != current:
                if len(ids):
                    yield ids, rows
                ids, rows, current = every[:0], x[:0], numbers[first]
            ids, rows = np.concatenate([ids, every[first:last]]), np.concatenate([rows, x[first:last]])
            done = 0
            while len(ids) - done >= 2 * BLOCK:
                yield ids[done : done + BLOCK], rows[done : done + BLOCK]
                done += BLOCK
            ids, rows = ids[done:], rows[done:]
    if len(ids):
        yield ids, rows


def _block_neighbours(ordered: DataFrame) -> DataFrame:
    """(id, other, d): each node's nearest within its block of consecutive nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            d = _squared(x)
            np.fill_diagonal(d, np.inf)
            k = min(DEGREE // 2, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
            yield pa.RecordBatch.from_pydict(
                {"id": np.repeat(ids, k), "other": ids[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel().astype(np.float32)}
            )

    return ordered.mapInArrow(run, "id long, other long, d float")


def _nearest(edges: DataFrame) -> DataFrame:
    """(id, near): of (id, other, d, new) the DEGREE nearest others by node, nearest first.

    A pair met before counts as known, at the least of its distances: these differ in the last digits
    with the place in a matrix product.
    """
    one = edges.repartition("id").groupBy("id", "other").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "other", "new"))), 1, DEGREE)
    return one.groupBy("id").agg(best.alias("near"))


def _local_join(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, other, d): what two neighbours of a node, one of them new, are to each other, and the way back of new edges.

    Left out is what is no nearer than the last of a full list: it could not get in.
    """
    full = F.size("near") >= DEGREE
    bound = graph.select("id", F.when(full, F.element_at("near", -1)["d"]).alias("bound"))
    targets = nodes.join(bound, "id", "left").select(F.col("id").alias("other"), "vector", F.coalesce("bound", F.lit(float("inf")).cast("float")).alias("bound"))
    # Lists without a new entry have been compared before.
    open_lists = graph.where(F.exists("near", lambda n: n["new"]))
    edges = open_lists.select("id", F.explode("near").alias("n")).select("id", "n.other", "n.d", "n.new")
    joined = edges.join(targets, "other")
    around = joined.groupBy("id").agg(F.collect_list(F.struct("other", "d", "new", "bound", "vector")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                part = whole.slice(first, 512)
                ids, entries = part.column("id").to_numpy(), part.column("n")
                sizes = entries.value_lengths().to_numpy()
                flat = entries.flatten()
                others, x = flat.field("other").to_numpy(), _matrix(flat.field("vector"))
                new = flat.field("new").to_numpy(zero_copy_only=False)
                d, bound = flat.field("d").to_numpy(), flat.field("bound").to_numpy()
                back = new & (d < bound)
                yield pa.RecordBatch.from_pydict({"id": others[back], "other": np.repeat(ids, sizes)[back], "d": d[back]})
                begin = np.cumsum(sizes) - sizes
                for size in np.unique(sizes):  # most lists are full, so there are few sizes
                    if size < 2:
                        continue
                    index = begin[sizes == size][:, None] + np.arange(size)
                    d = _squared(x[index])
                    fit = (new[index][:, :, None] | new[index][:, None, :]) & (d < bound[index][:, :, None])
                    fit[:, np.arange(size), np.arange(size)] = False
                    d = np.where(fit, d, np.inf)
                    k = max(1, min(int(size) - 1, DEGREE // 4))
                    near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                    d = np.take_along_axis(d, near, 2)
                    found = np.take_along_axis(np.broadcast_to(others[index][:, None, :], fit.shape), near, 2)
                    own, fit = np.broadcast_to(others[index][:, :, None], d.shape), np.isfinite(d)
                    yield pa.RecordBatch.from_pydict({"id": own[fit], "other": found[fit], "d": d[fit].astype(np.float32)})

    return around.select("id", "n").mapInArrow(run, "id long, other long, d float")


def build_graph(nodes: DataFrame) -> DataFrame:
    """(id, near): the neighbour graph of (id, vector), all vectors of one dimension; near has (d, other, new)."""
    first = nodes.first()
    if first is None:
        return nodes.sparkSession.createDataFrame([], "id long, near array<struct<d:float,other:long,new:boolean>>")
    spark = nodes.sparkSession
    count = nodes.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), PROJECTIONS * count // (4 * BLOCK)))
    order = ("number", "key", "id")
    keyed = _keyed(nodes, len(first.vector)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    graph = materialize(_nearest(_block_neighbours(keyed).withColumn("new", F.lit(True))), "graph")
    while True:
        known = graph.select("id", F.explode("near").alias("n")).select("id", "n.other", "n.d", F.lit(False).alias("new"))
        graph = materialize(_nearest(known.unionByName(_local_join(graph, nodes).withColumn("new", F.lit(True)))), "graph")
        changed = graph.select(F.sum(F.size(F.filter("near", lambda n: n["new"])))).first()[0] or 0
        if changed < CHANGED * DEGREE * count:
            return graph


def _distances(pairs: DataFrame) -> DataFrame:
    """(query, id, d): Euclidean distances in double precision of (query, id, q, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _matrix(batch.column("q"), np.float64) - _matrix(batch.column("v"), np.float64)
                yield pa.RecordBatch.from_pydict({"query": batch.column("query"), "id": batch.column("id"), "d": np.sqrt((d * d).sum(1))})

    return pairs.select("query", "id", "q", "v").mapInArrow(run, "query long, id long, d double")


def _search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(query, id, d): by query node the BEAM nearest nodes found, itself included."""
    edges = graph.select("id", F.explode("near.other").alias("other"))
    edges = materialize(edges.union(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    vectors = nodes.select("id", F.col("vector").alias("v"))
    asked = materialize(queries.select(F.col("id").alias("query")).join(nodes.select(F.col("id").alias("query"), F.col("vector").alias("q")), "query"), "queries")
    order = Window.partitionBy("query").orderBy("d", "id")
    closed_apart = Window.partitionBy("query", "open").orderBy("d", "id")

    def kept(seen: DataFrame) -> DataFrame:
        """The beam, and what of it is opened next. What falls out was farther than BEAM others; it would not be opened again."""
        best = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= BEAM).drop("n")
        next_ = ~F.col("open") & (F.row_number().over(closed_apart) <= OPENED)
        return materialize(best.withColumn("next", next_), "beam")

    beam = kept(asked.select("query", F.col("query").alias("id"), F.lit(0.0).alias("d"), F.lit(False).alias("open")))
    while not beam.where("next").isEmpty():
        reached = beam.where("next").select("query", "id").join(edges, "id").select("query", F.col("other").alias("id")).distinct()
        fresh = reached.join(beam.select("query", "id"), ["query", "id"], "left_anti")
        measured = _distances(fresh.join(vectors, "id").join(asked, "query"))
        seen = beam.select("query", "id", "d", (F.col("open") | F.col("next")).alias("open"))
        beam = kept(seen.unionByName(measured.withColumn("open", F.lit(False))))
    return beam.select("query", "id", "d")


def nearest_neighbours(table_: DataFrame, queries, id_column: str = "vec_id", vector_column: str = "embedding", *, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row that `queries` (a condition) picks.

    Nearest first by Euclidean distance in double precision, ties to the smaller id; a query is not
    its own neighbour. Rows take no part if their id or vector is null, or the vector is empty, zero
    or has a null or non-finite component, or another dimension than most (the larger, if tied).
    Copies of a vector are all candidates. Fewer than k others give fewer rows. Of rows that share an id
    one takes part, the one whose vector comes first in the order of arrays; it asks if any of them does.
    """
    spark = table_.sparkSession
    finite = F.forall(vector_column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    sound = F.col(id_column).isNotNull() & F.coalesce(finite & F.exists(vector_column, lambda x: x != 0), F.lit(False))
    # -0.0 becomes 0.0: they are equal in a window's key and differ as strings.
    plain = F.transform(vector_column, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = table_.where(sound).select(F.col(id_column).cast("long").alias("id"), plain.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("vector") == (sizes["size"] if sizes else 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    # The smallest k + 1 ids of each vector; the smallest stands for it in the graph.
    copies = rows.select("id", "vector").withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    copies = materialize(copies.withColumn("key", F.sha2(F.col("vector").cast("string"), 256)), "copies")
    nodes = materialize(copies.where("n = 1").select("id", "vector"), "nodes")
    members = materialize(copies.select("key", F.col("id").alias("member")).join(copies.where("n = 1").select("key", F.col("id").alias("id")), "key").select("id", "member"), "members")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.sha2(F.col("vector").cast("string"), 256).alias("key"))
    asking = materialize(asking.join(copies.where("n = 1").select("key", "id"), "key").select("query_id", F.col("id").alias("query")), "asking")

    beams = materialize(_search(asking.select(F.col("query").alias("id")).distinct(), nodes, build_graph(nodes)), "found")
    near = beams.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("n") <= k + 1)
    candidates = asking.join(near.join(members, "id"), "query").where("member != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "member"))
    out = candidates.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("member").alias(id_column), F.col("d").alias("score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
