"""ALS and FM side by side."""

from pyspark.sql import DataFrame, functions as F

from bipath.models import als, fm
from bipath.operators.evaluation import LABEL
from bipath.operators.features import FeatureCells
from bipath.operators.splits import train_test_split, with_split
from bipath.runtime import written

METRICS = "seed int, model string, split string, n long, rmse double"


def scored_by_all(models: dict[str, DataFrame]) -> DataFrame:
    """(drugId, proteinId, label, one column per model): the rows that every model has a score for."""
    result = None
    for name, rows in models.items():
        own = rows.filter(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
        own = own.select("drugId", "proteinId", LABEL, F.col("prediction").cast("double").alias(name))
        result = own if result is None else result.join(own.drop(LABEL), ["drugId", "proteinId"])
    return result


def compare_models(
    amount: DataFrame,
    ratings: als.Ratings,
    cells: FeatureCells,
    seeds: list[int],
    als_grid: dict = als.GRID,
    fm_grid: dict = fm.GRID,
    step_size: float = 0.1,
) -> DataFrame:
    """Both models on the same split of each seed and on the rows that both score, next to the mean training label.

    Per seed one table of scores is written, and one aggregate over it gives the errors of all models on both parts.
    """
    results = None
    for seed in seeds:
        train_keys, test_keys = train_test_split(amount.select("drugId", "proteinId"), seed)
        als_model = als.train(ratings, als_grid, train_keys, test_keys, seed).model
        fm_model = fm.train(amount, cells, fm_grid, train_keys, test_keys, seed, step_size).model
        mean = train_test_split(amount, seed)[0].agg(F.avg(LABEL)).first()[0]
        both = scored_by_all({"als": als_model.transform(ratings.data), "fm": fm.predict(fm_model, cells, amount)})
        both = with_split(written(both.withColumn("mean", F.lit(mean)), "scores"), seed)
        error = {m: F.sqrt(F.avg((F.col(m) - F.col(LABEL)) * (F.col(m) - F.col(LABEL)))).alias(m) for m in ("als", "fm", "mean")}
        rows = both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *error.values()).unpivot(["split", "n"], list(error), "model", "rmse")
        rows = rows.select(F.lit(seed).alias("seed"), "model", "split", "n", "rmse")
        results = rows if results is None else results.unionByName(rows)
    return results if results is not None else amount.sparkSession.createDataFrame([], METRICS)


def compare_rankings(als_ranking: DataFrame, fm_ranking: DataFrame) -> DataFrame:
    """Pairs that both rankings hold, with both ranks and their difference."""
    left = als_ranking.select("drugId", "proteinId", "rating", F.col("rank").alias("als_rank"))
    right = fm_ranking.select("drugId", "proteinId", "prediction", F.col("rank").alias("fm_rank"))
    return left.join(right, ["drugId", "proteinId"]).withColumn(
        "rank_difference", F.col("als_rank") - F.col("fm_rank")
    )
