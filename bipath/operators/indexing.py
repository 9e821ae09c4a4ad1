"""Global positions and running totals without a single-task sort.

The rows are range-partitioned in the asked order and sorted inside each partition. Positions in
a partition plus the totals of the partitions before it give global ones. The sorted rows are
written first: range bounds are sampled, so both uses must see the same partitions.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from bipath.runtime import written

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def _sorted_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    return (
        written(placed, "sorted")
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id")
    )


def _before_partition(rows: DataFrame, value: Column) -> DataFrame:
    """(_part, _before): one row per partition, so small enough for one window and a broadcast."""
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return F.broadcast(totals.select("_part", before.alias("_before")))


def dense_index(df: DataFrame, *order: Column, name: str = "idx", start: int = 0) -> DataFrame:
    """``df`` with the position of each row in a total order, counted from ``start``."""
    rows = _sorted_rows(df, list(order))
    position = F.col("_before") + F.col("_row") + start
    return (
        rows.join(_before_partition(rows, F.lit(1)), "_part")
        .withColumn(name, position.cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def running_total(df: DataFrame, *order: Column, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in a total order."""
    rows = _sorted_rows(df, list(order))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        rows.join(_before_partition(rows, F.col(value)), "_part")
        .withColumn(name, before.cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def index_by_frequency(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """(key, n, idx): the most frequent value is 0, ties in alphabetical order."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dense_index(counts, F.col("n").desc(), F.col(key), name=name)


def index_alphabetical(df: DataFrame, key: str, name: str = "idx", start: int = 0) -> DataFrame:
    """(key, idx) over the distinct values of ``key``."""
    return dense_index(df.select(key).distinct(), F.col(key), name=name, start=start)


def index_all_proteins(ppi: DataFrame) -> DataFrame:
    """(proteinId, idNum): 1-based ids over both sides of the edges."""
    ends = ppi.select(F.explode(F.array("proteinAId", "proteinBId")).alias("proteinId"))
    return index_alphabetical(ends, "proteinId", name="idNum", start=1)
