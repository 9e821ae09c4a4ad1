"""Network inputs derived from the star-schema test tables.

Supplier plays the drug, part the protein; consecutive lines of an order are an interaction.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bipath.operators.cleaning import RAW_A, RAW_B, RAW_DRUGS, RAW_PROTEIN, RAW_SCORE
from bipath.operators.edges import distinct_dti

SEEDS = ["P0", "P1", "P2", "P3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drug() -> Column:
    return F.concat(F.lit("D"), F.col("l_suppkey").cast("string"))


def _protein(column: str) -> Column:
    return F.concat(F.lit("P"), F.col(column).cast("string"))


def dti_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _drug().alias("drugId"), _protein("l_partkey").alias("proteinId")
    )


def dti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_dti(dti_rows(spark, sf_dir))


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    b = lines.select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_partkey").alias("b_partkey"),
        F.col("l_quantity").alias("b_quantity"),
    )
    return (
        a.join(b, ["l_orderkey", "l_linenumber"])
        .filter(F.col("l_partkey") < F.col("b_partkey"))
        .select(
            "l_orderkey",
            _protein("l_partkey").alias("proteinAId"),
            _protein("b_partkey").alias("proteinBId"),
            (F.least("l_quantity", "b_quantity") / 50).alias("score"),
        )
    )


def ppi_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interactions(spark, sf_dir).drop("l_orderkey")


def ppi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw interaction lines: foreign prefixes, extra confidence values, self-loops."""
    key = F.col("l_orderkey")
    known = F.lit("uniprotkb:")

    def tagged(column, n):
        return F.concat(F.when(key % n == 0, F.lit("chebi:")).otherwise(known), F.col(column))

    a = tagged("proteinAId", 5)
    b = F.when(key % 11 == 0, a).otherwise(tagged("proteinBId", 7))
    extra = F.when(key % 3 == 0, F.lit("|other:1")).otherwise(F.lit(""))
    confidence = F.concat(F.lit("intact-miscore:"), F.col("score").cast("string"), extra)
    return _interactions(spark, sf_dir).select(
        a.alias(RAW_A), b.alias(RAW_B), confidence.alias(RAW_SCORE)
    )


def dti_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw target lines: id lists with spaces and repeats."""
    line = F.concat(F.lit("D"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        _protein("l_partkey").alias(RAW_PROTEIN),
        F.concat_ws("; ", _drug(), line, _drug()).alias(RAW_DRUGS),
    )


def dirty_dti(spark: SparkSession, sf_dir: str) -> DataFrame:
    drug = F.when(F.col("l_orderkey") % 13 == 0, F.lit("")).otherwise(_drug())
    return table(spark, sf_dir, "lineitem").select(
        drug.alias("drugId"), _protein("l_partkey").alias("proteinId")
    )


def dirty_ppi(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_orderkey") % 17 != 0, F.col("score"))
    return _interactions(spark, sf_dir).select("proteinAId", "proteinBId", score.alias("score"))


def drug_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``drug`` element per part, as text lines of an XML file."""
    smiles = F.when(
        F.col("p_size") > 10,
        F.concat(F.lit("<property><kind>SMILES</kind><value>"), "p_type", F.lit("</value></property>")),
    ).otherwise(F.lit(""))
    key = F.col("p_partkey").cast("string")
    parts = [
        F.lit('<drug type="small molecule"><drugbank-id primary="true">DB'), key,
        F.lit("</drugbank-id><drugbank-id>ALT"), key,
        F.lit("</drugbank-id><calculated-properties><property><kind>logP</kind><value>1.5</value></property>"),
        smiles,
        F.lit("</calculated-properties><experimental-properties><property><kind>Water</kind>"
              "<value>2</value></property></experimental-properties>"
              '<targets><target><id>BE1</id><polypeptide id="P'), key,
        F.lit('" source="Swiss-Prot"><amino-acid-sequence format="FASTA">&gt;header\n'),
        F.col("p_brand"), F.lit("\n"), F.col("p_name"),
        F.lit("</amino-acid-sequence></polypeptide></target></targets></drug>"),
    ]
    return table(spark, sf_dir, "part").select(F.concat(*parts).alias("value"))
