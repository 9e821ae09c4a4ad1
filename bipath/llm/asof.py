"""As-of joins on ordered rows without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bipath.operators.indexing import _sorted_rows


def latest_before(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: ``value`` of the last earlier row of the same key where it isn't null.

    Rows are range-partitioned by key and order, so a key with a third of all rows spreads over many
    partitions. Inside a partition a window looks back; for the rows before a partition, one row per
    partition carries on what its last key has seen. Those carried rows are as many as partitions, whatever
    the data, so they meet in one window and are broadcast. The rows are written once to the shared folder.
    A null key joins nothing. Earlier means smaller in ``order``; full ties in it are in any order.
    """
    known = rows.filter(F.col(key).isNotNull())
    placed = _sorted_rows(known, [F.col(key), *(F.col(c) for c in order)])
    inside = Window.partitionBy("_part", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    edges = placed.groupBy("_part").agg(
        F.min_by(key, "_row").alias("_first"),
        F.max_by(key, "_row").alias("_last"),
        F.max_by(F.when(F.col(value).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v"))),
                 F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_seen"),
    )
    ends = edges.select(
        "_part", F.lit(1).alias("_side"), F.col("_last").alias("_key"),
        F.when(F.col("_seen.k") == F.col("_last"), F.col("_seen")).alias("_carried"),
    )
    starts = edges.select("_part", F.lit(0).alias("_side"), F.col("_first").alias("_key"), F.lit(None).cast(ends.schema["_carried"].dataType).alias("_carried"))
    before = Window.partitionBy("_key").orderBy("_part", "_side").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(starts).withColumn("_carried", F.last("_carried", ignorenulls=True).over(before))
    carried = carried.filter("_side = 0").select("_part", F.col("_key").alias(key), F.col("_carried.v").alias("_before"))
    found = placed.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    found = found.join(F.broadcast(carried), ["_part", key], "left").withColumn(name, F.coalesce("_here", "_before"))
    nothing = rows.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast(rows.schema[value].dataType))
    return found.select(*rows.columns, name).unionByName(nothing)
