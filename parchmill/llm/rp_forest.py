"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample of the distinct vectors: each node splits its sample
at the median of the projection on the difference of two of its points, of PAIRS such the one
that spreads them most. Every vector of the
table then gets its leaf in every tree. A query walks all trees through one priority queue,
nearest cell first (by the squared distances to the walls between), until the leaves it has reached hold SEARCH rows; these are ranked
exactly, in double precision.

Equal vectors are one entry with the few smallest ids that any answer can name, and equal
queries are one search, so a very common vector is no large cell. The rest of a cell is dealt
into blocks of bounded size, as are the queries that reach it.

Vectors that are null, zero, or hold null or non-finite components, rows without an id, and
vectors of another length than most take no part. Repeated rows count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import cut_lineage

NEIGHBOURS = 5
TREES = 12
SAMPLE = 20_000
PAIRS = 8  # directions tried for a split
LEAF_SAMPLE = 6  # a node with no more than twice as many sampled points is not split
LEAF_ROWS = 256  # vectors wanted in a leaf while the sample is fine enough
SEARCH = 32_000  # rows of the leaves that a query reaches; a vector has a row in every tree
BLOCK = 4_096  # vectors, and queries, of one leaf that meet in one group


@dataclass
class Forest:
    """Nodes of all trees: direction, threshold and children; a child below zero is leaf ~child."""

    roots: list[int]
    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    n_leaves: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int32)
        for tree, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            while len(inner := np.flatnonzero(node >= 0)):
                at = node[inner]
                far = (vectors[inner] * self.directions[at]).sum(axis=1) > self.thresholds[at]
                node[inner] = self.children[at, far.astype(int)]
            out[:, tree] = ~node
        return out

    def search(self, vector: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Leaves in order of nearness over all trees, until they hold ``wanted`` vectors."""
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        reached, held = [], 0
        while queue and held < wanted:
            cost, node = heapq.heappop(queue)
            if node < 0:
                reached.append(~node)
                held += int(sizes[~node])
                continue
            margin = float(vector @ self.directions[node] - self.thresholds[node])
            near, far = self.children[node, [int(margin > 0), int(margin <= 0)]].tolist()
            heapq.heappush(queue, (cost, near))
            heapq.heappush(queue, (cost + margin * margin, far))
        return reached


def plant(sample: np.ndarray, n_vectors: int, trees: int = TREES, seed: int = 0) -> Forest:
    """A forest over sampled unit vectors, for ``n_vectors`` in all."""
    rng = np.random.default_rng(seed)
    most = max(2 * LEAF_SAMPLE, round(LEAF_ROWS * len(sample) / max(1, n_vectors)))
    directions, thresholds, children, roots, n_leaves = [], [], [], [], 0

    for _ in range(trees):
        waiting: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while waiting:
            points, parent, side = waiting.pop()
            node, halves = None, None
            if len(points) > most:
                ends = sample[[rng.choice(points, 2, replace=False) for _ in range(PAIRS)]]
                tried = ends[:, 0] - ends[:, 1]
                tried /= np.maximum(np.linalg.norm(tried, axis=1, keepdims=True), 1e-300)
                reaches = sample[points] @ tried.T
                widest = int(reaches.var(axis=0).argmax())
                direction, reach = tried[widest], reaches[:, widest]
                threshold = float(np.median(reach))
                far = reach > threshold
                if far.any() and not far.all():
                    node, halves = len(directions), (points[~far], points[far])
                    directions.append(direction)
                    thresholds.append(threshold)
                    children.append([0, 0])
            if node is None:
                node, n_leaves = ~n_leaves, n_leaves + 1
            if parent < 0:
                roots.append(node)
            else:
                children[parent][side] = node
            if halves is not None:
                waiting += [(halves[0], node, 0), (halves[1], node, 1)]
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(
        roots,
        np.array(directions, dtype=np.float64).reshape(len(directions), width),
        np.array(thresholds),
        np.array(children, dtype=np.int64).reshape(-1, 2),
        n_leaves,
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), dtype=np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components leave the range of doubles.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector, key) of rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths["n"] if lengths else 0
    # -0.0 equals 0.0.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.where(F.size("vector") == width).withColumn("vector", plain)
    return rows.withColumn("key", F.xxhash64("vector"))


def entries(rows: DataFrame, names: int) -> DataFrame:
    """(key, vector, ids) of distinct vectors, with their ``names`` smallest ids."""
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= names)
    return few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))


def _with_leaves(found: DataFrame, forest: Forest) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.leaves(_unit(_matrix(batch.column(1))))
                made = pa.array(leaves.tolist(), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], ["key", "vector", "ids", "leaves"])

    return found.mapInArrow(run, "key long, vector array<double>, ids array<long>, leaves array<int>")


def _rank(key: tuple, queries: pa.Table, cells: pa.Table) -> pa.Table:
    """The nearest entries of a block to each query of a block."""
    left, right = _matrix(queries["query_vector"]), _matrix(cells["vector"])
    out = {"query": [], "key": [], "ids": [], "score": []}
    if len(left) and len(right):
        own, keys, ids = _unit(right), cells["key"].to_pylist(), cells["ids"].to_pylist()
        for query, vector in zip(queries["query"].to_pylist(), _unit(left), strict=True):
            score = (own * vector).sum(axis=1)
            # All that tie with the last one stay: ids decide between them later.
            last = np.partition(score, -min(len(score), NEIGHBOURS + 1))[-min(len(score), NEIGHBOURS + 1)]
            for i in np.flatnonzero(score >= last):
                out["query"].append(query)
                out["key"].append(keys[i])
                out["ids"].append(ids[i])
                out["score"].append(float(score[i]))
    return pa.table(out, schema=_RANKED)


_RANKED = pa.schema([
    ("query", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())
])


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    search: int = SEARCH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``. A row is no neighbour of its own id. If all
    trees together hold no more than ``search`` rows, the answer is exact.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    found = cut_lineage(entries(rows, k + 1))
    n = found.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 31))
    drawn = found if n <= SAMPLE else found.where(draw < int(0.97 * SAMPLE / n * (1 << 31)))
    sampled = _matrix(drawn.select("vector").orderBy("vector").limit(SAMPLE).toArrow()["vector"])
    forest = plant(_unit(sampled) if len(sampled) else sampled, n)
    index = cut_lineage(_with_leaves(found, forest))
    placed = index.select("key", "vector", "ids", F.explode("leaves").alias("leaf"))
    # As many rows as the forest has leaves, which the sample bounds.
    sizes = np.zeros(max(1, forest.n_leaves), dtype=np.int64)
    for row in placed.groupBy("leaf").count().collect():
        sizes[row.leaf] = row["count"]
    shared, shared_sizes = spark.sparkContext.broadcast(forest), spark.sparkContext.broadcast(sizes)

    asked = rows.where(is_query).select("id", "key", "vector")
    searches = asked.groupBy("key").agg(F.first("vector").alias("vector"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _unit(np.stack(batch["vector"].to_list())) if len(batch) else []
            reached = [shared.value.search(unit, shared_sizes.value, search) for unit in units]
            yield pd.DataFrame({"query": batch["key"], "query_vector": batch["vector"], "leaves": reached})

    routed = searches.mapInPandas(route, "query long, query_vector array<double>, leaves array<int>")
    routed = cut_lineage(routed).select("query", "query_vector", F.explode("leaves").alias("leaf"))
    asked_of = routed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).alias("query_blocks"))
    held_by = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    blocks = cut_lineage(asked_of.join(held_by, "leaf"))

    def part(name: str, count: str) -> Column:
        return F.pmod(F.col(name), F.col(count))

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    cells = placed.join(blocks, "leaf").withColumn("block", part("key", "blocks"))
    cells = cells.withColumn("query_block", each("query_blocks")).select(
        "leaf", "block", "query_block", "key", "vector", "ids"
    )
    probes = routed.join(blocks, "leaf").withColumn("query_block", part("query", "query_blocks"))
    probes = probes.withColumn("block", each("blocks")).select("leaf", "block", "query_block", "query", "query_vector")
    meet = ["leaf", "block", "query_block"]
    ranked = (
        probes.groupBy(*meet)
        .cogroup(cells.groupBy(*meet))
        .applyInArrow(_rank, "query long, key long, ids array<long>, score double")
    )
    # A vector is in a leaf of every tree: once is enough. Then its ids, and the best few.
    once = ranked.groupBy("query", "key").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    named = once.select("query", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    answers = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query")).distinct().join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
