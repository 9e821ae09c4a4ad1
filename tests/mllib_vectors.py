"""Whole feature vectors of pairs, as MLlib's own trainer takes them, to compare it with training over joins."""

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import FMRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bipath.models.fm import INTERCEPT, FMModel
from bipath.operators.features import FeatureCells
from bipath.runtime import scratch_path


def _cell_arrays(cells: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, <prefix>_indices, <prefix>_values): each entity's cells in feature order."""
    ordered = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("feature", "x"))).alias("cells"))
    return ordered.select(
        key,
        F.col("cells.feature").alias(f"{prefix}_indices"),
        F.col("cells.x").alias(f"{prefix}_values"),
    )


def _without(values: Column, position: Column) -> Column:
    """``values`` less the element at a 1-based position; all of them at position 0."""
    rest = F.concat(
        F.slice(values, F.lit(1), position - 1), F.slice(values, position + 1, F.size(values))
    )
    return F.when(position > 0, rest).otherwise(values)


def write_vector_rows(pairs: DataFrame, cells: FeatureCells) -> str:
    """Write ``pairs`` (drugId, proteinId, ...) with a sparse ``features`` vector; returns the path."""
    arrays_p = _cell_arrays(cells.protein_cells, "proteinId", "p")
    arrays_d = _cell_arrays(cells.drug_cells, "drugId", "d")
    keep = pairs.columns
    rows = pairs.join(arrays_p, "proteinId").join(arrays_d, "drugId")
    indices, values = F.col("d_indices"), F.col("d_values")
    if cells.own is not None:
        rows = rows.join(cells.own, "proteinId")
        own = F.array_position("d_indices", F.col("own_feature")).cast("int")
        indices, values = _without(indices, own), _without(values, own)
    # The stored form of an MLlib sparse vector.
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(cells.size).alias("size"),
        F.concat("p_indices", indices).alias("indices"),
        F.concat("p_values", values).alias("values"),
    )
    path = scratch_path(pairs.sparkSession, "features")
    rows.select(*keep, vector.alias("features")).write.parquet(path)
    return path


def read_vector_cells(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``features`` as its stored arrays (type, size, indices, values)."""
    return spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``features`` as MLlib vectors: the same arrays under another type,
    so no Python touches a row."""
    plain = [f for f in read_vector_cells(spark, path).schema.fields if f.name != "features"]
    schema = T.StructType([*plain, T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def vector_rows(pairs: DataFrame, cells: FeatureCells) -> DataFrame:
    return read_vectors(pairs.sparkSession, write_vector_rows(pairs, cells))


def from_mllib(spark: SparkSession, model: FMRegressionModel) -> FMModel:
    factors = model.factors.toArray()
    k = factors.shape[1]
    rows = pd.DataFrame(factors, columns=[f"v{f}" for f in range(k)])
    rows.insert(0, "w", model.linear.toArray())
    rows.insert(0, "feature", np.arange(len(rows), dtype="int32"))
    rows.loc[len(rows)] = [INTERCEPT, float(model.intercept)] + [0.0] * k
    return FMModel(spark.createDataFrame(rows.astype({"feature": "int32"})), k)
