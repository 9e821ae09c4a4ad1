"""Bounded samples of labelled rows, and the split that keeps some rows out of every fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3; rows with remainder 1 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def held_out(doc_id: str = "doc_id") -> Column:
    """A null doc_id is not held out, and no fit uses it."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def position(*columns: str) -> Column:
    """A pseudorandom place in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int, most_strata: int) -> tuple[list, dict]:
    """(rows, counts): at most ``per_stratum`` rows of each of the ``most_strata`` most frequent strata.

    The counts are over all rows. Which rows come is a function of ``key``, so a rerun draws the same ones, and
    no more than twice the wanted number reaches the driver.
    """
    known = rows.filter(F.col(stratum).isNotNull())
    tally = known.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), stratum).limit(most_strata)
    counts = {r[0]: r[1] for r in tally.collect()}
    if not counts:
        return [], counts
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, 1.5 * per_stratum / n))).otherwise(share)
    drawn = known.withColumn("_place", position(key)).filter(F.col("_place") < share)
    found = drawn.orderBy("_place", key).limit(2 * per_stratum * len(counts)).drop("_place").collect()
    taken: dict = {}
    kept = []
    for row in found:
        taken[row[stratum]] = taken.get(row[stratum], 0) + 1
        if taken[row[stratum]] <= per_stratum:
            kept.append(row)
    return kept, counts
