"""Neighbourhoods of seed proteins: whole, or with a ``limit`` per seed, edge or protein.

Every ``row_number() <= n`` below is cut per map task before the shuffle (WindowGroupLimit), so a
hub among the seeds sends n rows per task, not its edges.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bipath.operators.edges import SCORE_THRESHOLD, filter_score
from bipath.runtime import written
from bipath.sources.edges import edge_order, ids_from_list, scan_edges

# Seeds are typed in by a user; a longer list is joined without the broadcast hint.
MAX_BROADCAST_SEEDS = 10_000


def _first_per(edges: DataFrame, group: list[str], limit: int | None) -> DataFrame:
    if limit is None:
        return edges
    window = Window.partitionBy(*group).orderBy(*edge_order(edges))
    return edges.withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= limit).drop("nth")


def _seed_frame(spark: SparkSession, seeds: list[str], column: str) -> DataFrame:
    unique = sorted(set(seeds))
    frame = ids_from_list(spark, unique, column)
    return F.broadcast(frame) if len(unique) <= MAX_BROADCAST_SEEDS else frame


def seed_neighbourhood(ppi: DataFrame, seeds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The out-edges of each seed and, for seeds that have any, its in-edges; the first ``limit`` of each kind.

    Without seeds: all edges.
    """
    if seeds is None:
        return ppi
    spark = ppi.sparkSession
    out_edges = _first_per(
        ppi.join(_seed_frame(spark, seeds, "proteinAId"), "proteinAId", "left_semi"),
        ["proteinAId"],
        limit,
    )
    in_edges = _first_per(
        ppi.join(_seed_frame(spark, seeds, "proteinBId"), "proteinBId", "left_semi"),
        ["proteinBId"],
        limit,
    )
    with_out = out_edges.select(F.col("proteinAId").alias("proteinBId"))
    linked = in_edges.join(with_out, "proteinBId", "left_semi")
    columns = ["proteinAId", "proteinBId", "score"]
    return out_edges.select(columns).unionByName(linked.select(columns)).distinct()


def dti_of_edges(dti: DataFrame, ppi: DataFrame, limit: int | None = None) -> DataFrame:
    """The (first ``limit``) DTI of every A side of ``ppi``."""
    wanted = ppi.select(F.col("proteinAId").alias("proteinId")).distinct()
    return _first_per(dti.join(wanted, "proteinId", "left_semi"), ["proteinId"], limit).select("drugId", "proteinId")


def edges_within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """The distinct rows of ``edges`` (proteinAId, proteinBId, ...) that ``hops`` steps from the nodes of ``start`` touch.

    Each step takes the edges at the nodes found last, a semi join for each end, and goes on to those of their ends that were not
    there before. So a step moves the edges it touches and the nodes at their ends, never pairs of edges that meet in a
    node. Nodes and edges of a step are written; a null end is no node.
    """
    frontier = written(start.toDF("node").filter(F.col("node").isNotNull()).distinct(), "frontier")
    visited, layers = frontier, []
    for hop in range(hops):
        touched = reduce(
            DataFrame.unionByName,
            [edges.join(frontier.withColumnRenamed("node", end), end, "left_semi") for end in ("proteinAId", "proteinBId")],
        ).select(edges.columns)
        if hop + 1 == hops:
            layers.append(touched)
            break
        layers.append(written(touched, "touched"))
        ends = layers[-1].select(F.explode(F.array("proteinAId", "proteinBId")).alias("node"))
        new = ends.filter(F.col("node").isNotNull()).distinct().join(visited, "node", "left_anti")
        frontier = written(new, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, layers).distinct()


def ego_network(
    ppi: DataFrame,
    seed: str,
    threshold: float = SCORE_THRESHOLD,
    limit: int | None = None,
    hops: int = 2,
) -> DataFrame:
    """Strong edges within ``hops`` steps of the seed.

    With a ``limit`` of two steps: the first edges at the seed, and for each of them the first at either end. ``ppi``
    holds each edge once.
    """
    strong = filter_score(ppi, threshold).select("proteinAId", "proteinBId", "score")
    if limit is None:
        return edges_within(strong, ids_from_list(ppi.sparkSession, [seed], "node"), hops)
    if hops != 2:
        raise ValueError("a limit is for two steps")
    return _limited_ego(strong, seed, limit)


def _limited_ego(strong: DataFrame, seed: str, limit: int) -> DataFrame:
    """A second edge is taken at its A end where both of its ends match, so it comes once per first edge without a dedup."""
    touches_seed = (F.col("proteinAId") == seed) | (F.col("proteinBId") == seed)
    first = scan_edges(strong, touches_seed, limit)
    hop = first.select(
        F.struct("proteinAId", "proteinBId", "score").alias("via"),
        F.explode(F.array_distinct(F.array("proteinAId", "proteinBId"))).alias("node"),
    )
    by_end = strong.select(
        "*", F.explode(F.array_distinct(F.array("proteinAId", "proteinBId"))).alias("node")
    )
    a_matches = F.col("proteinAId").isin(F.col("via.proteinAId"), F.col("via.proteinBId"))
    second = (
        by_end.join(F.broadcast(hop), "node")  # two rows for each of the limit's edges
        .filter((F.col("node") == F.col("proteinAId")) | ~a_matches)
        .select("via", "proteinAId", "proteinBId", "score")
    )
    second = _first_per(second, ["via"], limit).select("proteinAId", "proteinBId", "score")
    return first.unionByName(second).distinct()


def dti_of_network(dti: DataFrame, ppi: DataFrame, limit: int | None = None) -> DataFrame:
    """The (first ``limit``) DTI of every end of ``ppi``."""
    ends = ppi.select(F.explode(F.array("proteinAId", "proteinBId")).alias("proteinId")).distinct()
    return _first_per(dti.join(ends, "proteinId", "left_semi"), ["proteinId"], limit).select("drugId", "proteinId")
