"""Filters, parsers and checks for raw edge rows."""

from pyspark.sql import Column, DataFrame, functions as F

from bipath.functions.text import confidence_score, has_known_prefix, is_blank, strip_known_prefix

# Column names of the raw files.
RAW_A = "#ID(s) interactor A"
RAW_B = "ID(s) interactor B"
RAW_SCORE = "Confidence value(s)"
RAW_PROTEIN = "UniProt ID"
RAW_DRUGS = "Drug IDs"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def filter_id_prefix(ppi_text: DataFrame) -> DataFrame:
    """Rows whose two interactors carry a known prefix; null interactors are dropped."""
    return ppi_text.filter(has_known_prefix(_c(RAW_A)) & has_known_prefix(_c(RAW_B)))


def filter_self_loops(edges: DataFrame, a: str = RAW_A, b: str = RAW_B) -> DataFrame:
    return edges.filter(_c(a) != _c(b))


def dedup_ppi_text(ppi_text: DataFrame) -> DataFrame:
    """One row per (A, B, confidence); no other column is kept, so the result is determined."""
    return ppi_text.select(_c(RAW_A), _c(RAW_B), _c(RAW_SCORE)).dropDuplicates()


def parse_ppi_text(ppi_text: DataFrame) -> DataFrame:
    return ppi_text.select(
        strip_known_prefix(_c(RAW_A)).alias("proteinAId"),
        strip_known_prefix(_c(RAW_B)).alias("proteinBId"),
        confidence_score(_c(RAW_SCORE)).alias("score"),
    )


def clean_ppi_text(ppi_text: DataFrame) -> DataFrame:
    """Raw PPI lines to (proteinAId, proteinBId, score): filters first, one shuffle to dedup."""
    return (
        ppi_text.transform(filter_id_prefix)
        .transform(filter_self_loops)
        .transform(dedup_ppi_text)
        .transform(parse_ppi_text)
    )


def split_drug_ids(dti_text: DataFrame) -> DataFrame:
    """One (drugId, proteinId) row per id of the ``;``-separated list, trimmed before the dedup."""
    return dti_text.select(
        F.explode(F.transform(F.split(_c(RAW_DRUGS), ";"), lambda i: F.trim(i))).alias("drugId"),
        F.trim(_c(RAW_PROTEIN)).alias("proteinId"),
    ).dropDuplicates()


def validate(df: DataFrame, texts: list[str], number: str | None = None, strict: bool = False) -> DataFrame:
    """``df`` with a ``reason`` column: the first failed check of the row, null on a good one.

    ``texts`` must be non-empty, ``number`` non-null. With ``strict`` the job fails on a bad row. A reason that a reader
    has given already stays.
    """
    reason = F.lit(None).cast("string")
    if number is not None:
        reason = F.when(F.col(number).isNull(), F.lit(f"{number} is absent"))
    for name in reversed(texts):
        reason = F.when(is_blank(F.col(name)), F.lit(f"{name} is blank")).otherwise(reason)
    if "reason" in df.columns:
        reason = F.coalesce(F.col("reason"), reason)
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(reason)
    return df.withColumn("reason", reason)


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def quarantined_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def add_suffix(df: DataFrame, suffix: str, key: str) -> DataFrame:
    """All columns but ``key`` renamed with ``suffix``, in one projection."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c != key})
