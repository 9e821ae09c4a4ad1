"""Connected components of a large edge list by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, longs
from bipath.runtime import written


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) of an edge list that fits a task; roots are left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch of edges becomes a forest of stars, which keeps what it connects."""
    for batch in batches:
        if batch.num_rows:
            node, root = spanning_forest(longs(batch, "a"), longs(batch, "b"))
            yield batch_of(a=node, b=root)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long) but the least of each component, which names it.

    Each task first turns its own edges into stars. Rounds then link every node's neighbours to the least
    of them, larger ones first and smaller ones next, until nothing changes; the number of rounds grows with
    the logarithm of the longest chain. A node's neighbours are never gathered: they meet the least
    one in a join, which Spark splits when a node has many. Edges from a node to itself
    link nothing, and edges with a null end are ignored. Each round is written to the shared folder.
    """
    ends = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    stars = written(ends.mapInArrow(_contract, "a long, b long").distinct(), "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.unionByName(least.filter("a > m").select("a", F.col("m").alias("b"))).distinct()
        lowest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(lowest, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        smaller = smaller.unionByName(lowest.select("a", F.col("m").alias("b")))
        stars = written(smaller.filter("a <> b").distinct(), "stars")
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return stars.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
