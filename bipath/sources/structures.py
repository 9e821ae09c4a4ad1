"""Drug SMILES and protein sequences from a drug XML dump."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bipath import schemas
from bipath.functions.text import fasta_body
from bipath.sources.splitting import split_elements, xml_elements

ELEMENT = "drug"  # fixed value of the dump
_CORRUPT = "_malformed"


def parse_drug_xml(spark: SparkSession, path: str) -> DataFrame:
    """(element, drug, reason): every outer ``drug`` element of the dump, its text and its parsed form, read by many tasks.

    Elements may have any attributes, or none, and hold drugs of their own, as those of their pathways. The reason is null
    for a drug that could be read and has a primary id.
    """
    schema = T.StructType([*schemas.DRUG_XML.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"rowTag": ELEMENT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    elements = split_elements(spark, path, xml_elements(ELEMENT))
    parsed = elements.select("element", F.from_xml("element", schema, options).alias("drug"))
    broken = F.col("drug").isNull() | F.col(f"drug.{_CORRUPT}").isNotNull()
    reason = F.when(broken, "not well formed").when(_primary_id("drug.").isNull(), "no primary id")
    return parsed.withColumn("reason", reason)


def drugs_of(parsed: DataFrame) -> DataFrame:
    """The drugs of :func:`parse_drug_xml` that could be read."""
    kept = [F.col(f"drug.`{f.name}`") for f in schemas.DRUG_XML.fields]
    return parsed.filter(F.col("reason").isNull() | (F.col("reason") == "no primary id")).select(*kept)


def rejected_elements(parsed: DataFrame) -> DataFrame:
    """(element, reason) of the elements that give no drug."""
    return parsed.filter(F.col("reason").isNotNull()).select("element", "reason")


def read_drug_xml(spark: SparkSession, path: str, plain: bool = False, rejected: bool = False) -> DataFrame:
    """One row per well-formed outer ``drug`` element of the dump; with ``rejected`` (element, reason) of the others.

    ``plain`` takes Spark's own XML source, which reads a file in one task. A dump is one file.
    """
    if plain:
        return spark.read.format("xml").option("rowTag", ELEMENT).schema(schemas.DRUG_XML).load(path)
    parsed = parse_drug_xml(spark, path)
    return rejected_elements(parsed) if rejected else drugs_of(parsed)


def _primary_id(inside: str = "") -> Column:
    flagged = F.filter(F.col(f"{inside}`drugbank-id`"), lambda i: i["_primary"] == "true")
    return F.get(flagged, F.lit(0))["_VALUE"]


def _with_primary_id(drugs: DataFrame) -> DataFrame:
    return drugs.withColumn("drugId", _primary_id()).filter(F.col("drugId").isNotNull())


def drug_smiles(drugs: DataFrame) -> DataFrame:
    """(drugId, smiles): the first SMILES property of each drug that has one."""
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    properties = F.concat(
        F.coalesce(F.col("`calculated-properties`.property"), empty),
        F.coalesce(F.col("`experimental-properties`.property"), empty),
    )
    smiles = F.filter(properties, lambda p: p["kind"] == "SMILES")
    return (
        _with_primary_id(drugs)
        .withColumn("found", F.get(smiles, F.lit(0)))
        .filter(F.col("found").isNotNull())
        .select("drugId", F.col("found.value").alias("smiles"))
        .distinct()
    )


def protein_sequences(drugs: DataFrame) -> DataFrame:
    """(proteinId, fasta): the first polypeptide of every target; fasta is null without a header
    line or a sequence element, which :func:`bipath.operators.cleaning.validate` then reports."""
    return (
        _with_primary_id(drugs)
        .select(F.explode("targets.target").alias("target"))
        .select(F.get(F.col("target.polypeptide"), F.lit(0)).alias("chain"))
        .filter(F.col("chain").isNotNull())
        .select(
            F.col("chain._id").alias("proteinId"),
            fasta_body(F.col("chain.`amino-acid-sequence`._VALUE")).alias("fasta"),
        )
        .distinct()
    )
