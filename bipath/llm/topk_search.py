"""Exact top-k inner-product search with a KD-tree per shard.

Vectors become integers, floor(scale * x), so scores are exact. The shards are cells of a KD-tree over a bounded sample of
the vectors, and a cell with many vectors is split further by hash, so a shard has a bounded size even where one
vector comes a million times. In a shard, a KD-tree with median splits keeps the tight bounding box of each
node; the greatest possible score of a query in a box bounds what the node can hold. A query goes through the nodes best first
and stops when the best bound left is below its kth score.

Queries come in blocks of bounded size. Each block first visits one shard, the one whose box promises its queries most.
The kth scores found there travel with the queries to the other shards, whose boxes they rule out; a shard
gets only the queries that can still improve. Then each query's best k of all shards are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bipath.llm.streams import batch_of, changes, column, longs, whole_groups
from bipath.runtime import written

SCALE = 256
LEAF = 128
SHARD_ROWS = 16_384
SAMPLE_ROWS = 8_192
QUERY_BLOCK = 512


class Tree:
    """Nodes of a KD-tree in one list: boxes, children, and the rows of each leaf."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.low, self.high, self.children, self.rows = [], [], [], []
        stack = [(np.arange(len(vectors)), None)]
        while stack:
            rows, parent = stack.pop()
            own = vectors[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.rows.append(None)
            if parent is not None:
                self.children[parent].append(node)
            axis = int(np.argmax(high - low)) if len(low) else 0
            if len(rows) <= leaf or not len(low) or high[axis] == low[axis]:
                self.rows[node] = rows
                continue
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            stack.append((rows[order[:half]], node))
            stack.append((rows[order[half:]], node))
        self.low, self.high = np.array(self.low), np.array(self.high)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query with a point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, query_id, query, bound, k: int, floor) -> list[tuple]:
    """The best k (score, -vec_id) in this shard that reach ``floor``, best first."""
    best: list[tuple] = []  # a heap whose first entry is the worst kept
    heap = [(-bound[0], 0)]
    while heap:
        promise, node = heapq.heappop(heap)
        least = max(floor, best[0][0]) if len(best) == k else floor
        if -promise < least:
            break
        rows = tree.rows[node]
        if rows is None:
            for child in tree.children[node]:
                heapq.heappush(heap, (-bound[child], child))
            continue
        scores = vectors[rows] @ query
        for i in np.flatnonzero(scores >= least):
            if ids[rows[i]] != query_id:
                entry = (int(scores[i]), -int(ids[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return sorted(best, reverse=True)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy().astype(np.int64)
    matrix = flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0), np.int64)
    # Products of doubles are exact while no partial sum passes 2**53.
    top = np.abs(matrix).max(initial=0)
    return matrix.astype(np.float64) if top * top * matrix.shape[1] < 1 << 53 else matrix


def _visit(k: int):
    """Rows of a shard, then its queries, all under one key: the k best of each query in the shard."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        table = table.combine_chunks()
        edge = np.append(np.flatnonzero(changes(table.column("shard").to_numpy(), table.column("block").to_numpy())), table.num_rows)
        for a, b in zip(edge[:-1], edge[1:]):
            part = table.slice(a, b - a)
            asked = part.column("query").combine_chunks()
            is_query = asked.is_valid().to_numpy(zero_copy_only=False)
            asked = asked.drop_null().to_pylist()
            ids, floors = part.column("id").to_numpy(), part.column("floor").to_numpy()
            matrix = _matrix(part.column("v").combine_chunks())
            if is_query.all() or not is_query.any():
                continue
            rows, queries = matrix[~is_query], matrix[is_query]
            tree = Tree(rows, LEAF)
            bound = bounds(queries, tree.low, tree.high)
            for q, (row, query_id, floor) in enumerate(zip(asked, ids[is_query].tolist(), floors[is_query].tolist())):
                for score, vec in search(tree, ids[~is_query], rows, query_id, queries[q], bound[q], k, floor):
                    out["query"].append(row)
                    out["query_id"].append(query_id)
                    out["vec_id"].append(-vec)
                    out["score"].append(score)
        yield batch_of(**{c: pa.array(v, pa.int64()) for c, v in out.items()})

    def visit(batches):
        yield from whole_groups(batches, ["shard", "block"], work)

    return visit


def _cells(sample: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """Splits (node, axis, value, is a leaf) of a tree over the sample; node i has children 2i and 2i + 1."""
    splits, stack = {}, [(1, sample)]
    while stack:
        node, rows = stack.pop()
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(spread))
        if len(rows) <= most or spread[axis] == 0:
            continue
        value = float(np.median(rows[:, axis]))
        left = rows[:, axis] < value
        if not left.any():
            left = rows[:, axis] <= value
            value = float(np.nextafter(value, np.inf))
        splits[node] = (axis, value)
        stack += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return splits


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a column."""
    lengths = column.value_lengths().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, _matrix(column.take(pa.array(rows))).reshape(len(rows), int(length))


def _place(splits: dict[int, dict]):
    """The cell of each vector among those of its length."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.ones(batch.num_rows, np.int64)
            for rows, matrix in _by_length(column(batch, "v")):
                own, cell, moving = splits.get(matrix.shape[1], {}), np.ones(len(rows), np.int64), True
                while moving:
                    moving = False
                    for node in np.unique(cell):
                        if int(node) in own:
                            axis, value = own[int(node)]
                            here = cell == node
                            cell[here] = 2 * node + (matrix[here, axis] >= value)
                            moving = True
                cells[rows] = cell
            yield batch_of(**{c: column(batch, c) for c in batch.schema.names}, cell=cells)

    return place


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One box for each shard in a batch, a row for each component; boxes of one shard are merged later."""
    for batch in batches:
        for rows, matrix in _by_length(column(batch, "v")):
            shard = longs(batch, "shard")[rows]
            order = np.argsort(shard, kind="stable")
            first = np.flatnonzero(changes(shard[order]))
            low = np.minimum.reduceat(matrix[order], first).astype(np.int64)
            high = np.maximum.reduceat(matrix[order], first).astype(np.int64)
            yield batch_of(
                shard=shard[order][first], low=pa.array(low.tolist(), pa.list_(pa.int64())),
                high=pa.array(high.tolist(), pa.list_(pa.int64())),
            )


def _merged_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One box of each shard, from its parts in a row; holds one."""

    def told():
        return batch_of(
            shard=pa.array([held[0]], pa.int64()), low=pa.array([held[1].tolist()], pa.list_(pa.int64())),
            high=pa.array([held[2].tolist()], pa.list_(pa.int64())),
        )

    held = None
    for batch in batches:
        for shard, low, high in zip(*(column(batch, c).to_pylist() for c in ("shard", "low", "high"))):
            low, high = np.array(low, np.int64), np.array(high, np.int64)
            if held is not None and held[0] == shard:
                held = (shard, np.minimum(held[1], low), np.maximum(held[2], high))
                continue
            if held is not None:
                yield told()
            held = (shard, low, high)
    if held is not None:
        yield told()


def quantized(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null id, and null or not finite vectors, go."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = rows.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return whole.select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"),
    )


def _sample(vectors: DataFrame, total: int) -> dict[int, dict]:
    """Splits of the cells of each length, from about ``SAMPLE_ROWS`` rows of all lengths."""
    place = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20))
    drawn = vectors.filter(place < int(min(1.0, SAMPLE_ROWS / total) * (1 << 20)) + 1)
    sample = drawn.orderBy(place, "id", "v").limit(2 * SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    most = max(1, len(sample) // max(1, -(-total // SHARD_ROWS)))
    return {m.shape[1]: _cells(m, most) for _, m in _by_length(sample) if m.shape[1]}


def top_k(rows: DataFrame, k: int, every: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, the k best rows of other ids.

    Scores are integer inner products, ties go to the smaller id, ranks count from 1. Every row takes part but those with a null
    id or a vector that is null or holds null or non-finite components. Vectors of different lengths are multiplied as far
    as both go, an empty one gives 0. Rows that share an id are rows of their own as candidates, and together one query,
    whose k best are those of all its rows. Fewer than k other rows give fewer results; an empty table gives none.
    """
    spark = rows.sparkSession
    vectors = quantized(rows, id_column, vector)
    result = "query long, query_id long, vec_id long, score long"
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    splits = _sample(vectors, total)
    placed = vectors.mapInArrow(_place(splits), "id long, v array<bigint>, cell long")
    # A row's number is fixed by writing it.
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()).withColumn("length", F.size("v")), "vectors")
    counts = placed.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("pieces"))
    shard = F.xxhash64("length", "cell", F.pmod(F.xxhash64("row"), F.col("pieces")))
    shards = placed.join(counts, ["length", "cell"]).select("id", "v", shard.alias("shard"))
    each = shards.mapInArrow(_boxes, "shard long, low array<bigint>, high array<bigint>")
    each = each.repartition("shard").sortWithinPartitions("shard")
    boxes = written(each.mapInArrow(_merged_boxes, "shard long, low array<bigint>, high array<bigint>"), "boxes")

    queries = placed.filter(F.pmod("id", F.lit(every)) == 0).select("row", "id", "v")
    blocks = max(1, -(-(total // every + 1) // QUERY_BLOCK))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(9)), F.lit(blocks))), "queries")
    promise = F.aggregate(
        F.zip_with("v", F.zip_with("low", "high", lambda a, b: F.struct(a.alias("l"), b.alias("h"))),
                   lambda q, e: F.coalesce(F.when(q > 0, q * e["h"]).otherwise(q * e["l"]), F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    # Boxes are one row per SHARD_ROWS vectors; every query block meets them in an equi join on the block. Only numbers go on.
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    promised = queries.join(boxes.withColumn("block", every_block), "block").select(
        "row", "block", "shard", F.size("low").alias("length"), promise.alias("promise")
    )
    promised = written(promised, "promises")

    def visited(asked: DataFrame) -> DataFrame:
        wanted = asked.select("shard", "block").distinct()
        none = F.lit(None).cast("long")
        stored = shards.join(wanted, "shard").select("shard", "block", none.alias("query"), "id", "v", F.lit(0).cast("long").alias("floor"))
        # A query is cut or filled up with zeros to the length of the shard's vectors.
        fit = F.when(F.col("length") <= F.size("v"), F.slice("v", 1, F.col("length"))).otherwise(
            F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.col("length") - F.size("v")))
        )
        own = asked.join(queries.select("row", "id", "v"), "row")
        own = own.select("shard", "block", F.col("row").alias("query"), "id", fit.alias("v"), "floor")
        both = stored.unionByName(own).repartition("shard", "block").sortWithinPartitions("shard", "block")
        return both.mapInArrow(_visit(k), result)

    home = promised.groupBy("row").agg(F.max_by("shard", F.struct("promise", "shard")).alias("home"))
    lowest = F.lit(-(1 << 62)).cast("long")
    placed_queries = promised.join(home, "row")
    first = written(visited(placed_queries.filter("shard = home").withColumn("floor", lowest)), "first-visit")
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    rest = (
        placed_queries.filter("shard <> home")
        .join(kth, F.col("query") == F.col("row"), "left")
        .withColumn("floor", F.when(F.col("n") >= k, F.col("worst")).otherwise(lowest))
        .filter(F.col("promise") >= F.col("floor"))
        .drop("query")
    )
    found = first.unionByName(visited(rest))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
