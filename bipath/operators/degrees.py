"""Degrees, their distributions, and network totals."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bipath.operators.edges import distinct_dti


def _rows() -> Column:
    return F.count(F.lit(1))


def ppi_degree(symmetric: DataFrame) -> DataFrame:
    """(proteinId, degree, neighbours) on both-direction edges.

    ``degree`` counts both ends of both directions, so it is twice the number of neighbours; as
    every edge is there in both directions, that is twice the rows of the A side.
    """
    return symmetric.groupBy(F.col("proteinAId").alias("proteinId")).agg(
        (_rows() * 2).alias("degree"), _rows().alias("neighbours")
    )


def drug_degree(dti: DataFrame) -> DataFrame:
    return distinct_dti(dti).groupBy("drugId").agg(_rows().alias("degree"))


def target_degree(dti: DataFrame) -> DataFrame:
    return distinct_dti(dti).groupBy("proteinId").agg(_rows().alias("degree"))


def target_distribution_raw(dti_rows: DataFrame) -> DataFrame:
    """Rows per protein with repeats counted."""
    return dti_rows.groupBy("proteinId").agg(_rows().alias("amount"))


def degree_total(dti: DataFrame, symmetric: DataFrame) -> DataFrame:
    """(proteinId, degree) of each target: its drugs plus its PPI degree, 0 where it has none."""
    ppi = ppi_degree(symmetric).select("proteinId", F.col("degree").alias("ppi_degree"))
    return (
        target_degree(dti)
        .join(ppi, "proteinId", "left")
        .select("proteinId", (F.col("degree") + F.coalesce("ppi_degree", F.lit(0))).alias("degree"))
    )


def degree_distribution(degrees: DataFrame) -> DataFrame:
    """(degree, n): how many entities have each degree."""
    return degrees.groupBy("degree").agg(_rows().alias("n"))


def degree_frequency(distribution: DataFrame) -> DataFrame:
    """The distribution as shares of all entities; the total is a one-row scalar subquery."""
    total = distribution.agg(F.sum("n")).scalar()
    return distribution.withColumn("frequency", F.col("n") / total)


def label_histogram(amount: DataFrame) -> DataFrame:
    return amount.groupBy("amount_interactions").agg(_rows().alias("n"))


def network_summary(dti: DataFrame, ppi_raw: DataFrame, symmetric: DataFrame, strong: DataFrame) -> DataFrame:
    """(metric, value) rows: sizes of the edge sets and of the entity sets behind them.

    Each edge set is read once and grouped with counts; its row total is a sum over the groups. A null entity
    counts as one entity.
    """

    def entities(column):
        return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))

    def metrics(grouped, **values):
        totals = grouped.agg(*(F.coalesce(v.cast("long"), F.lit(0)).alias(k) for k, v in values.items()))
        pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values))
        return totals.select(F.inline(pairs))

    def grouped(df, *columns):
        return df.groupBy(*columns).agg(_rows().alias("n"))

    frames = [
        metrics(
            grouped(dti, "drugId", "proteinId"),
            dti_rows=F.sum("n"), dti=_rows(), drugs=entities("drugId"), targets=entities("proteinId"),
        ),
        metrics(grouped(ppi_raw, "proteinAId"), ppi_rows=F.sum("n"), interactors_a=_rows()),
        metrics(grouped(symmetric, "proteinAId"), ppi=F.sum("n"), proteins=_rows()),
        metrics(grouped(strong, "proteinAId"), ppi_matrix_width=_rows()),
    ]
    return reduce(DataFrame.unionByName, frames)
