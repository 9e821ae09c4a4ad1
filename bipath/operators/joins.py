"""Joins whose tasks stay bounded: hot keys spread over many tasks, outputs dealt by their rows, lookups without a sort."""

from pyspark.sql import DataFrame, functions as F

from bipath.runtime import written

# Pairs of one key that one task may make, and the edge of the blocks that a hotter key is cut into.
BLOCK_ROWS = 4096
# Rows that one task of a dealt frame gets, about.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into tasks of about ``TASK_ROWS`` of its ``rows`` rows.

    Adaptive execution merges partitions by their compressed bytes, so millions of short rows come into one task, and more
    still where the rows are multiplied there; their hash maps then pass its memory. A given number is not merged. Short
    frames are left to Spark.
    """
    if rows <= TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def lookup(table: DataFrame) -> DataFrame:
    """``table``, short beside the rows it is joined to, for a join that does not sort these rows.

    Spark broadcasts it where its size threshold allows that. Otherwise each task holds its part of the table, a few rows for a key, as
    a hash map. Give a written table, whose size Spark knows.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table if size <= limit else table.hint("shuffle_hash")


def hot_key_join(left: DataFrame, right: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``left.join(right, key)`` with the pairs of a hot key cut into a grid of blocks.

    A hub joined to a hub gives rows(left) x rows(right) output rows from two short inputs, which
    adaptive skew handling does not see, as it goes by input bytes. A key is hot when that product is
    above ``block_rows`` squared, whatever its share of the rows. Its rows are hashed into slots of about
    ``block_rows``, and each is repeated once per slot of the other side, so every pair still meets exactly
    once and no task gets more than about block_rows x block_rows of them.

    Both sides are written first, so each is computed once for the count and the join. Where no key is hot, as most
    often, the join is a plain one. Otherwise cold rows go through a plain join, and hot keys are found again by a join on
    the key, a broadcast only if Spark's size threshold allows it; with one row per key on that side, Spark can split it.
    """
    return joined_pairs(written(left, "join-left"), written(right, "join-right"), key, block_rows)[0]


def joined_pairs(left: DataFrame, right: DataFrame, key: str, block_rows: int = BLOCK_ROWS, weight: int = 1) -> tuple[DataFrame, int]:
    """:func:`hot_key_join` of two written tables, and the number of its rows, by which a later shuffle can be dealt. ``weight`` is the
    number of short rows that a joined one counts for."""
    counts = written(_key_counts(left, right, key), "key-counts")
    pairs = int(counts.agg(F.sum(_pairs())).first()[0] or 0)
    hot = written(_slots_of(counts, key, block_rows), "hot-keys")
    names = [key, *(c for c in left.columns if c != key), *(c for c in right.columns if c != key)]
    if hot.isEmpty():
        return dealt(left, pairs * weight, key).join(dealt(right, pairs * weight, key), key).select(names), pairs
    cold = dealt(left.join(hot, key, "left_anti"), pairs * weight, key).join(dealt(right, pairs * weight, key), key)
    spread_left = _spread(left, hot, key, own="ls", other="rs")
    spread_right = _spread(right, hot, key, own="rs", other="ls")
    spread = spread_left.join(spread_right, [key, "ls", "rs"])
    return cold.select(names).unionByName(spread.select(names)), pairs


def _key_counts(left, right, key):
    def counted(df, name):
        return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))

    return counted(left, "l").join(counted(right, "r"), key)


def _pairs():
    # Decimals, as the product of two counts can pass a long.
    return F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")


def _hot_slots(left, right, key, block_rows):
    return _slots_of(_key_counts(left, right, key), key, block_rows)


def _slots_of(counts, key, block_rows):
    slots = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    return counts.filter(_pairs() > block_rows**2).select(key, slots("l").alias("l_slots"), slots("r").alias("r_slots"))


def _spread(df, hot, key, own, other):
    """The rows of hot keys in slots, each once for every slot of the other side; equal rows get slots of their own."""
    mine, theirs = ("l_slots", "r_slots") if own == "ls" else ("r_slots", "l_slots")
    # The number of a row of a written table is the same when a task is run again.
    numbered = df.withColumn(own, F.xxhash64(F.monotonically_increasing_id())).join(hot, key)
    copies = F.sequence(F.lit(0), F.col(theirs) - 1)
    return numbered.select(*df.columns, F.pmod(own, F.col(mine)).cast("int").alias(own), F.explode(copies).alias(other))
