"""Files in and out, and the faulty rows in them."""

import os

import pytest
from conftest import rows
from pyspark.sql import DataFrameWriter, functions as F

from bipath import runtime, schemas, sinks, sources
from bipath.functions import confidence_score, fasta_body, strip_known_prefix
from bipath.models import selection
from bipath.operators import cleaning
from bipath.plans import etl


def test_delimited_keeps_short_lines_and_rejects_long_ones(spark, tmp_path):
    file = tmp_path / "dti.csv"
    file.write_text('UniProt ID,Drug IDs,Note\nP1,D1; D2,x\nP2,D3\nP3,D4,y,z\nP4,"D5,D6","a ""b"", c"\nP5,D7,"p,q",r\n')
    df = sources.read_delimited(spark, str(file), ",")
    assert df.columns == ["UniProt ID", "Drug IDs", "Note"]
    assert rows(df) == [("P1", "D1; D2", "x"), ("P2", "D3", None), ("P4", "D5,D6", 'a "b", c')]
    assert rows(sources.read_delimited(spark, str(file), ",", rejected=True)) == [
        ("P3,D4,y,z",), ('P5,D7,"p,q",r',),
    ]
    # Columns may be pruned without changing which lines count as good.
    assert sorted(r[0] for r in df.select("UniProt ID").collect()) == ["P1", "P2", "P4"]
    with pytest.raises(ValueError):
        sources.read_delimited(spark, "")


def test_json_array_and_lines(spark, tmp_path):
    array = tmp_path / "a.json"
    array.write_text('[\n {"_id": {"$oid": "1"}, "drugId": "D1", "proteinId": "P1"},\n {"drugId": "D2", "proteinId": "P2"}\n]')
    assert rows(sources.read_dti_json(spark, str(array), one_document=True)) == [("D1", "P1"), ("D2", "P2")]
    lines = tmp_path / "b.json"
    lines.write_text('{"proteinAId": "P1", "proteinBId": "P2", "score": 1}\n[{"proteinAId": "P3", "proteinBId": "P4", "score": 0.5}]\n')
    assert rows(sources.read_ppi_json(spark, str(lines))) == [("P1", "P2", 1.0), ("P3", "P4", 0.5)]


XML = """<?xml version="1.0" encoding="UTF-8"?>
<drugbank xmlns="http://www.drugbank.ca">
<drug type="small molecule" created="2005-06-13">
  <drugbank-id primary="true">DB1</drugbank-id><drugbank-id>OLD1</drugbank-id>
  <pathways><pathway><drugs><drug><drugbank-id>DB9</drugbank-id></drug></drugs></pathway></pathways>
  <calculated-properties><property><kind>logP</kind><value>1</value></property>
    <property><kind>SMILES</kind><value>CC(=O)O</value></property></calculated-properties>
  <targets><target><polypeptide id="P1"><amino-acid-sequence format="FASTA">&gt;h
MA
KL</amino-acid-sequence></polypeptide></target>
  <target><polypeptide id="P2"><amino-acid-sequence>NOHEADER</amino-acid-sequence></polypeptide></target>
  <target><name>none</name></target></targets>
</drug>
<drug type="biotech"><drugbank-id>NOPRIMARY</drugbank-id>
  <calculated-properties><property><kind>SMILES</kind><value>X</value></property></calculated-properties></drug>
<drug type="biotech"><drugbank-id primary="true">DB2</drugbank-id>
  <experimental-properties><property><kind>SMILES</kind><value>N</value></property></experimental-properties>
  <targets><target><polypeptide id="P1"><amino-acid-sequence>&gt;h
MA
KL</amino-acid-sequence></polypeptide></target></targets></drug>
</drugbank>
"""


@pytest.mark.parametrize("plain", [False, True])
def test_drug_xml(spark, tmp_path, plain):
    file = tmp_path / "dump.xml"
    file.write_text(XML)
    drugs = sources.read_drug_xml(spark, str(file), plain)
    assert rows(sources.drug_smiles(drugs)) == [("DB1", "CC(=O)O"), ("DB2", "N")]
    assert rows(sources.protein_sequences(drugs)) == [("P1", "MAKL"), ("P2", None)]


def test_structures_load_quarantines_the_missing_sequence(spark, tmp_path):
    file = tmp_path / "dump.xml"
    file.write_text(XML)
    drugs, proteins = str(tmp_path / "d"), str(tmp_path / "p")
    _, loaded = etl.structures_to_collections(spark, str(file), drugs, proteins, str(tmp_path / "r"))
    assert rows(spark.read.parquet(proteins)) == [("P1", "MAKL")] and loaded == etl.Loaded(1, 1)
    assert [r.proteinId for r in spark.read.parquet(str(tmp_path / "r/proteins")).collect()] == ["P2"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "r/elements")).collect()] == ["no primary id"]


def _drug(attributes, key, smiles):
    return (
        f'<drug {attributes}><drugbank-id primary="true">{key}</drugbank-id><calculated-properties><property>'
        f"<kind>SMILES</kind><value>{smiles}</value></property></calculated-properties></drug>\n"
    )


def test_drug_xml_with_attributes_in_any_order_and_a_malformed_record(spark, tmp_path):
    file = tmp_path / "dump.xml"
    records = [_drug('created="x" type="b"', "DB1", "C"), _drug('type="b"', "DB2", "a & b"), _drug('updated="y"', "DB3", "N")]
    file.write_text("<?xml version='1.0'?>\n<drugbank>\n" + "".join(records) + "</drugbank>\n")
    assert rows(sources.drug_smiles(sources.read_drug_xml(spark, str(file)))) == [("DB1", "C"), ("DB3", "N")]
    rejected = sources.read_drug_xml(spark, str(file), rejected=True).collect()
    assert [r.reason for r in rejected] == ["not well formed"] and "DB2" in rejected[0].element


def test_cleaning_functions(spark):
    df = spark.createDataFrame([("uniprotkb:P1", "a|intact-miscore:0.56|b:1"), ("chebi:P1", "none")], "i string, c string")
    got = rows(df.select(strip_known_prefix(F.col("i")), confidence_score(F.col("c"))))
    assert got == [("P1", 0.56), (None, None)]
    assert rows(spark.createDataFrame([(">h\nA\nB",), ("AB",)], "s string").select(fasta_body(F.col("s")))) == [("AB",), (None,)]


def test_clean_ppi_text(spark):
    raw = [
        ("uniprotkb:P1", "uniprotkb:P2", "intact-miscore:0.5"),
        ("uniprotkb:P1", "uniprotkb:P2", "intact-miscore:0.5"),
        ("uniprotkb:P1", "uniprotkb:P1", "intact-miscore:0.5"),
        ("chebi:1", "uniprotkb:P1", "intact-miscore:0.5"),
        (None, "uniprotkb:P1", "intact-miscore:0.5"),
    ]
    df = spark.createDataFrame(raw, "a string, b string, c string").toDF(cleaning.RAW_A, cleaning.RAW_B, cleaning.RAW_SCORE)
    assert rows(cleaning.clean_ppi_text(df)) == [("P1", "P2", 0.5)]


def test_validation_quarantine_and_strict_mode(spark):
    df = spark.createDataFrame([("P1", "P2", 0.1), ("", "P2", 0.1), ("P1", None, 0.1), ("P1", "P2", None)], schemas.PPI)
    checked = cleaning.validate(df, ["proteinAId", "proteinBId"], "score")
    assert rows(cleaning.valid_rows(checked)) == [("P1", "P2", 0.1)]
    reasons = sorted(r.reason for r in cleaning.quarantined_rows(checked).collect())
    assert reasons == ["proteinAId is blank", "proteinBId is blank", "score is absent"]
    for bad, reason in ((("", "P2", 0.1), "proteinAId is blank"), (("P1", None, 0.1), "proteinBId is blank"), (("P1", "P2", None), "score is absent")):
        one = spark.createDataFrame([bad], schemas.PPI)
        with pytest.raises(Exception, match=reason):
            cleaning.validate(one, ["proteinAId", "proteinBId"], "score", strict=True).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("D1", "P1")], schemas.DTI)
    for _ in range(2):
        sinks.append_edges(df, str(tmp_path / "c"))
        sinks.overwrite_csv(df, str(tmp_path / "csv"))
        sinks.insert_into_table(df, "dti_sink", path=str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == spark.table("dti_sink").count() == 2
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("D1", "P1")]
    spark.sql("DROP TABLE dti_sink")


def test_a_batch_is_published_once_and_after_a_failure(spark, tmp_path, monkeypatch):
    source, good, bad = (str(tmp_path / n) for n in ("dti.csv", "good", "bad"))
    (tmp_path / "dti.csv").write_text("UniProt ID,Drug IDs\nP1,D1; D2\n,D3\nP4,D4\n")
    write, calls = DataFrameWriter.parquet, []

    def broken(self, path, *more, **options):
        calls.append(path)
        if len(calls) == 3:  # the checked rows, the rejected ones, and then the good ones
            raise OSError("lost")
        return write(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        etl.dti_text_to_collection(spark, source, good, bad, "monday")
    monkeypatch.undo()
    assert not os.path.exists(good) and not [f for f in os.listdir(bad) if f.startswith("batch-")]
    for _ in range(2):
        assert etl.dti_text_to_collection(spark, source, good, bad, "monday") == etl.Loaded(3, 1)
    # A call that broke off between its moves is replaced by the next one.
    os.remove(f"{good}/_published-monday")
    assert etl.dti_text_to_collection(spark, source, good, bad, "monday") == etl.Loaded(3, 1)
    assert rows(spark.read.parquet(good)) == [("D1", "P1"), ("D2", "P1"), ("D4", "P4")]
    assert spark.read.parquet(bad).count() == 1
    etl.dti_text_to_collection(spark, source, good, bad, "tuesday")
    assert spark.read.parquet(good).count() == 6 and spark.read.parquet(bad).count() == 2
    with pytest.raises(ValueError):
        sinks.publish({good: spark.range(1)}, "../x")


def test_scans_are_ordered_and_bounded(hand_ppi):
    assert [tuple(r) for r in sources.scan_edges(hand_ppi, F.col("score") > 0, 2).collect()] == [("P1", "P3", 0.9), ("P1", "P2", 0.8)]
    assert rows(sources.find_one(hand_ppi, F.col("proteinAId") == "none")) == []
    with pytest.raises(ValueError):
        sources.find_one(hand_ppi, None)


def test_intermediates_are_deleted_with_their_scope(spark):
    with runtime.intermediates(spark) as root:
        assert runtime.written(spark.range(5)).count() == 5 and os.path.isdir(root.removeprefix("file:"))
    assert not os.path.exists(root.removeprefix("file:"))


def test_the_best_of_a_grid_is_never_nan():
    assert selection.lowest([float("nan"), 0.5, 0.5]) == 1 and selection.lowest([float("nan")]) == 0


def test_scratch_paths_lie_in_the_shared_folder(spark):
    assert runtime.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
