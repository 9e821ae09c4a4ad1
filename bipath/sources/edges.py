"""Predicate scans over stored edges, and small user-supplied lists."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

def edge_order(edges: DataFrame) -> list[Column]:
    """The total order behind every limit: strongest PPI first, DTI by ids."""
    if "score" in edges.columns:
        return [F.col("score").desc(), F.col("proteinAId"), F.col("proteinBId")]
    return [F.col("drugId"), F.col("proteinId")]


def scan_edges(edges: DataFrame, predicate: Column | None = None, limit: int | None = None) -> DataFrame:
    """The edges that satisfy ``predicate``; with a ``limit``, the first so many in edge order."""
    if predicate is not None:
        edges = edges.filter(predicate)
    return edges if limit is None else edges.orderBy(*edge_order(edges)).limit(limit)


def find_one(edges: DataFrame, predicate: Column) -> DataFrame:
    """The first edge that satisfies ``predicate``, or no row."""
    if predicate is None:
        raise ValueError("a predicate is required")
    return scan_edges(edges, predicate, limit=1)


def edges_from_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A frame from a short list typed in by a user; edge lists proper come from files."""
    return spark.createDataFrame(list(rows), schema)


def ids_from_list(spark: SparkSession, ids: Iterable[str], column: str) -> DataFrame:
    schema = T.StructType([T.StructField(column, T.StringType(), False)])
    return spark.createDataFrame([(i,) for i in ids], schema)
