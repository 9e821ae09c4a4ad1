"""A join of many rows with one row per key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bipath.runtime import written

HEAVY = 1_000  # keys that are spread, the most frequent ones
SPREAD_ROWS = 4_096  # rows of such a key that meet in one place


def left_join_spread(rows: DataFrame, one: DataFrame, key: str, by: str, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """``rows.join(one, key, "left")``, where ``one`` holds a key once at most.

    The rows of the most frequent keys are dealt to slots by a hash of column ``by``, and their row of ``one`` comes once for each slot.
    The list of these keys, a fixed number of them at most, is broadcast; any other key has less than one row in ``HEAVY``. Rows without
    a key meet nothing. ``rows`` is read three times, so give a table or what is cheap to compute.
    """
    known = rows.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > spread_rows)
    heavy = counts.orderBy(F.col("_n").desc(), key).limit(HEAVY).select(key, F.ceil(F.col("_n") / spread_rows).cast("int").alias("_slots"))
    heavy = F.broadcast(written(heavy, "heavy-keys"))
    slot = F.coalesce(F.pmod(F.xxhash64(by), F.col("_slots")).cast("int"), F.lit(0))
    dealt = known.join(heavy, key, "left").withColumn("_slot", slot).drop("_slots")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1))
    copied = one.join(heavy, key, "left").withColumn("_slot", copies).drop("_slots")
    names = [*rows.columns, *(c for c in one.columns if c != key)]
    met = dealt.join(copied, [key, "_slot"], "left").select(names)
    nothing = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in one.columns if c != key]
    return met.unionByName(rows.filter(F.col(key).isNull()).select(*rows.columns, *nothing))
