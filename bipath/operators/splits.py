"""Train/test and fold columns from the row key."""

from pyspark.sql import DataFrame, functions as F

from bipath.functions.buckets import key_bucket
from bipath.operators.joins import lookup

TRAIN_PERCENT = 80
KEYS = ("drugId", "proteinId")


def with_split(df: DataFrame, seed: int, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """``df`` with ``split`` = train or test, by a hash of (drugId, proteinId, seed)."""
    in_train = key_bucket(*KEYS, seed=seed) % 100 < train_percent
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))


def train_test_split(df: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, seed)
    return tuple(marked.filter(F.col("split") == part).drop("split") for part in ("train", "test"))


def with_fold(df: DataFrame, seed: int, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", (key_bucket(*KEYS, seed=seed) % folds).cast("int"))


def restrict_to_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (drugId, proteinId) is in ``keys``."""
    return df.join(lookup(keys.select(*KEYS)), list(KEYS), "left_semi")


def given_or_split(
    df: DataFrame, train: DataFrame | None, test: DataFrame | None, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The rows of two given key sets, or an own split where none is given."""
    if (train is None) != (test is None):
        raise ValueError("give both a training and a test set, or neither")
    if train is None:
        return train_test_split(df, seed)
    return restrict_to_keys(df, train), restrict_to_keys(df, test)
