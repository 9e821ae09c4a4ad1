"""Loads from raw files to collections and tables.

A load splits its rows: good ones go to the sink, bad ones with the reason to ``rejected_path``. Both come from one
written table, so the input is read and parsed once. A load returns the number of good and bad rows.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from bipath import schemas
from bipath.operators.cleaning import (
    clean_ppi_text,
    quarantined_rows,
    split_drug_ids,
    valid_rows,
    validate,
)
from bipath.runtime import written
from bipath.sinks import append_edges, insert_into_table, publish
from bipath.sources import (
    drug_smiles,
    drugs_of,
    parse_drug_xml,
    parse_edges,
    protein_sequences,
    read_delimited,
    rejected_elements,
)


@dataclass(frozen=True)
class Loaded:
    good: int
    bad: int


def checked_dti(dti: DataFrame, strict: bool = False) -> DataFrame:
    return validate(dti, ["drugId", "proteinId"], strict=strict)


def checked_ppi(ppi: DataFrame, strict: bool = False) -> DataFrame:
    return validate(ppi, ["proteinAId", "proteinBId"], "score", strict)


def valid_dti(dti: DataFrame, strict: bool = False) -> DataFrame:
    return valid_rows(checked_dti(dti, strict))


def valid_ppi(ppi: DataFrame, strict: bool = False) -> DataFrame:
    return valid_rows(checked_ppi(ppi, strict))


def _counted(rows: DataFrame) -> Loaded:
    bad = F.count(F.col("reason"))
    n = rows.agg((F.count(F.lit(1)) - bad).alias("good"), bad.alias("bad")).first()
    return Loaded(n["good"], n["bad"])


def _load(checked: DataFrame, rejected_path: str, sink) -> Loaded:
    rows = written(checked, "checked")
    sink(valid_rows(rows))
    append_edges(quarantined_rows(rows), rejected_path)
    return _counted(rows)


def _collect(checked: DataFrame, collection: str, rejected_path: str, batch: str | None) -> Loaded:
    """Good rows go to the collection, bad ones to the rejected path. With the name of a ``batch`` both come as one step, and a
    call that is repeated under it, be it after a failure, adds nothing twice."""
    if batch is None:
        return _load(checked, rejected_path, lambda df: append_edges(df, collection))
    rows = written(checked, "checked")
    publish({rejected_path: quarantined_rows(rows), collection: valid_rows(rows)}, batch)
    return _counted(rows)


def ppi_text_to_collection(spark: SparkSession, source: str, collection: str, rejected_path: str, batch: str | None = None) -> Loaded:
    edges = clean_ppi_text(read_delimited(spark, source, "\t"))
    return _collect(checked_ppi(edges), collection, rejected_path, batch)


def dti_text_to_collection(spark: SparkSession, source: str, collection: str, rejected_path: str, batch: str | None = None) -> Loaded:
    edges = split_drug_ids(read_delimited(spark, source, ","))
    return _collect(checked_dti(edges), collection, rejected_path, batch)


def structures_to_collections(
    spark: SparkSession, source: str, drug_collection: str, protein_collection: str, rejected_path: str
) -> tuple[Loaded, Loaded]:
    """Drugs and proteins of one XML dump, which is parsed once; malformed elements go to ``rejected_path``/elements."""
    parsed = written(parse_drug_xml(spark, source), "drugs")
    drugs = drugs_of(parsed)
    append_edges(rejected_elements(parsed), f"{rejected_path}/elements")
    smiles = validate(drug_smiles(drugs), ["drugId", "smiles"])
    fasta = validate(protein_sequences(drugs), ["proteinId", "fasta"])
    return (
        _load(smiles, f"{rejected_path}/drugs", lambda df: append_edges(df, drug_collection)),
        _load(fasta, f"{rejected_path}/proteins", lambda df: append_edges(df, protein_collection)),
    )


def collection_to_table(spark: SparkSession, collection: str, table: str, **options: str) -> None:
    insert_into_table(spark.read.parquet(collection), table, **options)


def dti_json_to_table(spark: SparkSession, source: str, table: str, rejected_path: str, **options: str) -> Loaded:
    """Rejected rows come with the text of their JSON object, be it broken or only short of an id."""
    checked = checked_dti(parse_edges(spark, source, schemas.DTI))
    return _load(checked, rejected_path, lambda df: insert_into_table(df.drop("element"), table, **options))


def ppi_json_to_table(spark: SparkSession, source: str, table: str, rejected_path: str, **options: str) -> Loaded:
    """As :func:`dti_json_to_table`."""
    checked = checked_ppi(parse_edges(spark, source, schemas.PPI))
    return _load(checked, rejected_path, lambda df: insert_into_table(df.drop("element"), table, **options))
