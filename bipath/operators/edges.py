"""Edge-set operators."""

from pyspark.sql import DataFrame, functions as F

SCORE_THRESHOLD = 0.5


def distinct_dti(dti: DataFrame) -> DataFrame:
    return dti.select("drugId", "proteinId").distinct()


def filter_score(ppi: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    return ppi.filter(F.col("score") >= threshold)


def swap_edge(ppi: DataFrame) -> DataFrame:
    return ppi.select(
        F.col("proteinBId").alias("proteinAId"), F.col("proteinAId").alias("proteinBId"), "score"
    )


def max_score_per_pair(ppi: DataFrame) -> DataFrame:
    return ppi.groupBy("proteinAId", "proteinBId").agg(F.max("score").alias("score"))


def symmetrize_ppi(ppi: DataFrame, threshold: float | None = None) -> DataFrame:
    """Both directions of every edge with the best score of the unordered pair.

    The pair is brought into one order first, so the input is scanned once and each undirected
    edge crosses the shuffle once; both directions are made from the aggregate. A threshold is
    applied before it, which keeps the same pairs and maxima (Catalyst does not push a filter
    on a maximum through the aggregate). Rows with a null end are no edges and go; validation reports them.
    """
    ppi = ppi.filter(F.col("proteinAId").isNotNull() & F.col("proteinBId").isNotNull())
    if threshold is not None:
        ppi = filter_score(ppi, threshold)
    a, b = F.col("proteinAId"), F.col("proteinBId")
    pairs = ppi.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(
        F.max("score").alias("score")
    )
    ends = F.struct(F.col("lo").alias("proteinAId"), F.col("hi").alias("proteinBId"))
    back = F.struct(F.col("hi").alias("proteinAId"), F.col("lo").alias("proteinBId"))
    directions = F.when(F.col("lo") == F.col("hi"), F.array(ends)).otherwise(F.array(ends, back))
    return pairs.select(F.explode(directions).alias("edge"), "score").select("edge.*", "score")
