"""A key-hash bucket that any SQL engine can reproduce."""

from pyspark.sql import Column, functions as F


def key_bucket(*columns, seed: int) -> Column:
    """The first 32 bits of md5(``columns`` and ``seed`` joined by ``|``), as a long.

    It depends on the row's key alone, so a split built on it is the same after any
    repartitioning, retry or rerun.
    """
    digest = F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
