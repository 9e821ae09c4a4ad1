"""Two-hop paths drug -> known target -> interacting protein, and their counts."""

from pyspark.sql import DataFrame, functions as F

from bipath.functions.buckets import key_bucket
from bipath.operators.edges import SCORE_THRESHOLD, distinct_dti, filter_score, symmetrize_ppi
from bipath.operators.joins import dealt, hot_key_join, joined_pairs, lookup
from bipath.runtime import written

# Targets kept in one array of a target list.
LIST_SIZE = 4096


def two_hop_paths(dti: DataFrame, ppi: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """(drugId, proteinId, proteinBId, score) for every distinct target and strong edge of it."""
    edges = filter_score(ppi, threshold).withColumnRenamed("proteinAId", "proteinId")
    return hot_key_join(dti, edges, "proteinId").select("drugId", "proteinId", "proteinBId", "score")


def count_paths(paths: DataFrame) -> DataFrame:
    return paths.groupBy("drugId", "proteinBId").agg(F.count(F.lit(1)).alias("amount_interactions"))


def exclude_known_targets(ends: DataFrame, dti: DataFrame) -> DataFrame:
    """Rows whose ``proteinBId`` is not yet a target of their drug."""
    known = dti.select("drugId", F.col("proteinId").alias("proteinBId"))
    return ends.join(lookup(known), ["drugId", "proteinBId"], "left_anti")


def amount_interactions(
    dti: DataFrame, ppi_raw: DataFrame, threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """(drugId, proteinId, amount_interactions): how many targets of the drug interact with a
    protein that is no target of it.

    Paths are counted before known targets go, and the anti join runs on the very (drug, protein)
    partitioning of the count, so the paths are shuffled once. Their number is known from the key counts of
    the join; many paths are dealt into tasks by it. They are not summed up before that shuffle: the paths of a task
    end in about as many (drug, protein) pairs, whose hash map would be held for nothing. Targets and edges are
    written once for all their readers; scores are done with after the threshold.
    """
    targets = written(distinct_dti(dti.dropna(subset=["drugId", "proteinId"])), "targets")
    edges = symmetrize_ppi(ppi_raw, threshold).select(F.col("proteinAId").alias("proteinId"), "proteinBId")
    paths, n = joined_pairs(targets, written(edges, "edges"), "proteinId")
    counted = count_paths(dealt(paths, n, "drugId", "proteinBId"))
    return exclude_known_targets(counted, targets).select(
        "drugId", F.col("proteinBId").alias("proteinId"), "amount_interactions"
    )


def targets_per_drug(dti: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """(drugId, piece, pieces, proteins): each drug's sorted distinct targets.

    One array per drug up to ``list_size`` targets; a larger set comes as ceil(n / list_size)
    pieces, cut by a hash of the target, so no array grows with the drug.
    """
    targets = distinct_dti(dti)
    pieces = targets.groupBy("drugId").agg(
        F.ceil(F.count(F.lit(1)) / list_size).cast("int").alias("pieces")
    )
    piece = (key_bucket("proteinId", seed=0) % F.col("pieces")).cast("int")
    return (
        hot_key_join(targets, pieces, "drugId")
        .groupBy("drugId", piece.alias("piece"), "pieces")
        .agg(F.sort_array(F.collect_list("proteinId")).alias("proteins"))
    )


def flag_known_targets(paths: DataFrame, dti: DataFrame) -> DataFrame:
    """Every path with the size of its drug's target list and whether its end is in that list.

    Membership is a join with the DTI rows, so no list is copied onto the paths.
    """
    targets = distinct_dti(dti)
    sizes = targets.groupBy("drugId").agg(F.count(F.lit(1)).alias("n_targets"))
    known = targets.select("drugId", F.col("proteinId").alias("proteinBId"), F.lit(True).alias("hit"))
    return (
        paths.join(known, ["drugId", "proteinBId"], "left")
        .join(sizes, "drugId")
        .select(
            "drugId",
            "proteinId",
            "proteinBId",
            "n_targets",
            F.coalesce("hit", F.lit(False)).alias("interactor_drug_target"),
        )
    )
