"""The biological network as plain node and edge tables."""

from pyspark.sql import DataFrame, functions as F


def graph_edges(dti: DataFrame, ppi: DataFrame) -> DataFrame:
    """(src, dst): undirected simple edges of both kinds, ends in order; rows with a null end are no edges."""

    def undirected(df, a, b):
        whole = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        return whole.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))

    return (
        undirected(dti, "drugId", "proteinId")
        .unionByName(undirected(ppi, "proteinAId", "proteinBId"))
        .distinct()
    )


def graph_nodes(dti: DataFrame, ppi: DataFrame) -> DataFrame:
    """(id, kind): protein if the id is a target or an interactor anywhere, else drug.

    Each end is tagged with what it proves, and one aggregate by id settles the kind.
    """

    def tagged(df, ends):
        pairs = [F.struct(F.col(c).alias("id"), F.lit(p).alias("is_protein")) for c, p in ends]
        return df.select(F.explode(F.array(*pairs)).alias("end")).select("end.*")

    ends = tagged(dti, [("drugId", False), ("proteinId", True)]).unionByName(
        tagged(ppi, [("proteinAId", True), ("proteinBId", True)])
    )
    return ends.groupBy("id").agg(
        F.when(F.max("is_protein"), "protein").otherwise("drug").alias("kind")
    )
