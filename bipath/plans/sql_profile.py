"""The SQL derivation of the network numbers: directed edges, repeated DTI rows, known targets kept.

It differs from :mod:`bipath.operators.twohop` by design and serves as a cross-check on it.
"""

from pyspark.sql import DataFrame

from bipath.operators.edges import SCORE_THRESHOLD
from bipath.operators.joins import dealt, joined_pairs, lookup
from bipath.runtime import written


def ppis_for_analysis(ppi_raw: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Best score of each directed pair above the threshold."""
    return ppi_raw.sparkSession.sql(
        """
        SELECT proteinAId, proteinBId, max(score) AS score
        FROM {ppi} WHERE score >= {threshold}
        GROUP BY proteinAId, proteinBId
        """,
        ppi=ppi_raw,
        threshold=threshold,
    )


def amount_manual(dti_rows: DataFrame, ppis: DataFrame) -> DataFrame:
    """(drugId, proteinBId, paths): joined DTI rows per drug and path end.

    Repeated DTI rows are counted before the join and summed after it, in tasks dealt by the number of joined rows.
    """
    spark = dti_rows.sparkSession
    dti = spark.sql(
        "SELECT drugId, proteinId, count(*) AS n FROM {dti} GROUP BY drugId, proteinId", dti=dti_rows
    )
    ends = spark.sql("SELECT proteinAId AS proteinId, proteinBId FROM {ppis}", ppis=ppis)
    joined, rows = joined_pairs(written(dti), written(ends), "proteinId")
    return spark.sql(
        """
        SELECT drugId, proteinBId, sum(n) AS paths
        FROM {joined} GROUP BY drugId, proteinBId
        """,
        joined=dealt(joined, rows, "drugId", "proteinBId"),
    )


def amount_match(amount: DataFrame, manual: DataFrame) -> DataFrame:
    """(matches): rows of the two derivations that agree in drug, protein and count.

    Both sides are partitioned by (drug, protein) already. Equal counts are tested as a zero
    difference, since a third equality would become a join key and shuffle both sides again.
    """
    return amount.sparkSession.sql(
        """
        SELECT count(*) AS matches
        FROM {counted} counted JOIN {derived} derived
          ON counted.drugId = derived.drugId AND counted.proteinId = derived.proteinBId
        WHERE counted.amount_interactions - derived.paths = 0
        """,
        counted=amount,
        derived=lookup(manual),
    )


def sql_ppi_degree(ppis: DataFrame) -> DataFrame:
    return ppis.sparkSession.sql(
        "SELECT proteinAId AS proteinId, count(*) AS protein_degree FROM {ppis} GROUP BY proteinAId", ppis=ppis
    )


def targets_of_drugs(dti_rows: DataFrame) -> DataFrame:
    return dti_rows.sparkSession.sql(
        "SELECT drugId, count(*) AS drug_targets FROM {dti} GROUP BY drugId", dti=dti_rows
    )


def drugs_of_proteins(dti_rows: DataFrame) -> DataFrame:
    return dti_rows.sparkSession.sql(
        "SELECT proteinId, count(*) AS protein_drugs FROM {dti} GROUP BY proteinId", dti=dti_rows
    )


def complete_profile(dti_rows: DataFrame, ppis: DataFrame) -> DataFrame:
    """Every counted (drug, path end) with the degrees of both and the end's drugs, 0 if none.

    The degrees depend on the drug or the end alone, so they join the counts, not the paths.
    """
    return dti_rows.sparkSession.sql(
        """
        SELECT drugId, counts.proteinBId, drug_targets, protein_degree,
               coalesce(protein_drugs, 0) AS protein_drugs, paths
        FROM {counts} counts
        JOIN {drugs} drugs USING (drugId)
        JOIN {ends} ends ON ends.proteinId = counts.proteinBId
        LEFT JOIN {users} users ON users.proteinId = counts.proteinBId
        """,
        counts=amount_manual(dti_rows, ppis),
        drugs=targets_of_drugs(dti_rows),
        ends=sql_ppi_degree(ppis),
        users=drugs_of_proteins(dti_rows),
    )
