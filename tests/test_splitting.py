"""Large XML and JSON files cut by structure, over ranges of a few hundred bytes."""

import json
import random
import re

import pytest
from conftest import rows

from bipath import sources
from bipath.plans import etl
from bipath.sources import splitting


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of 300 bytes, so elements, comments and strings lie over range ends."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def drug(opening, key, smiles, inner=""):
    return (
        f'{opening}<drugbank-id primary="true">{key}</drugbank-id>{inner}<calculated-properties><property>'
        f"<kind>SMILES</kind><value>{smiles}</value></property></calculated-properties></drug>"
    )


NESTED = "<pathways><pathway><drugs>" + '<drug\n created="1"><drugbank-id>IN</drugbank-id></drug><drug/><drug x=">"></drug>' * 4 + "</drugs></pathway></pathways>"
OPENINGS = ["<drug>", "<drug type='b'>", '<drug\ntype="b">', '<drug\ttype="b" >', '<drug\n\n  created="2005"\r\n type="a > b">', '<drug x="/">', "<drug x='/' >"]
BETWEEN = [
    "\n", "", "<!-- <drug> -->", "<other><drugs/></other>", "<![CDATA[ </drug> <drug> ]]>", "<?note <drug>?>", "<!--" + " <drug a='" * 60 + "-->",
    "<drugbank-id>text</drugbank-id>", "<![CDATA[" + "]] > <drug>" * 50 + "]]>",
]


def dump(seed, n=80):
    """(text of a dump, smiles by id, ids of the malformed elements)."""
    rng = random.Random(seed)
    text, good, bad = ["<?xml version='1.0'?>\n<drugbank xmlns='http://x'>"], [], []
    for i in range(n):
        key, inner = f"DB{i}", rng.choice(["", NESTED, "<a>" + "x" * rng.randrange(2000) + "</a>", "<!-- </drug> -->", "<b><![CDATA[</drug>]]></b>"])
        if i % 11 == 5:
            bad.append(key)
            text.append(drug(rng.choice(OPENINGS), key, rng.choice(["a & b", "<i>", "&nope;"]), inner))
        else:
            good.append((key, f"C{i}é"))
            text.append(drug(rng.choice(OPENINGS), key, f"C{i}é", inner))
        text.append(rng.choice(BETWEEN))
    return "".join([*text, "</drugbank>\n"]), sorted(good), sorted(bad)


@pytest.mark.parametrize("seed", range(4))
def test_every_drug_is_returned_or_rejected(spark, tmp_path, small_ranges, seed):
    text, good, bad = dump(seed)
    (tmp_path / "dump.xml").write_text(text)
    parsed = sources.parse_drug_xml(spark, str(tmp_path / "dump.xml"))
    assert spark.read.text(str(tmp_path / "dump.xml"), lineSep="<").rdd.getNumPartitions() > 30
    assert rows(sources.drug_smiles(sources.drugs_of(parsed))) == good
    rejected = sources.rejected_elements(parsed).collect()
    assert sorted(re.search(r"DB\d+", r.element)[0] for r in rejected) == bad
    assert {r.reason for r in rejected} <= {"not well formed"}
    assert sources.drugs_of(parsed).count() + len(rejected) == len(good) + len(bad)


def test_the_cut_drugs_are_those_of_the_plain_source(spark, tmp_path, small_ranges):
    plain = "\n".join(drug(OPENINGS[i % 2], f"DB{i}", f"C{i}", NESTED if i % 3 == 0 else "") for i in range(60))
    file = tmp_path / "dump.xml"
    file.write_text(f"<drugbank>{plain}</drugbank>")
    want = rows(sources.drug_smiles(sources.read_drug_xml(spark, str(file), plain=True)))
    assert rows(sources.drug_smiles(sources.read_drug_xml(spark, str(file)))) == want
    assert len(want) == 60


def test_broken_openings_and_ends_lose_nothing(spark, tmp_path, small_ranges):
    file = tmp_path / "dump.xml"
    a, b, c = drug("<drug>", "DB1", "C"), drug("<drug>", "DB2", "N"), drug("<drug>", "DB3", "O")
    file.write_text(f'<drugbank>{a}</drug></drug>{drug("<drug a=x", "DB4", "P")}{b}{c[:-7]}')
    assert rows(sources.drug_smiles(sources.read_drug_xml(spark, str(file)))) == [("DB1", "C"), ("DB2", "N")]
    rejected = sources.read_drug_xml(spark, str(file), rejected=True).collect()
    assert sorted(re.search(r"DB\d", r.element)[0] for r in rejected) == ["DB3", "DB4"]
    file.write_text("<drugbank></drugbank>")
    assert rows(sources.read_drug_xml(spark, str(file))) == []


def test_many_files_and_empty_drugs(spark, tmp_path, small_ranges):
    folder = tmp_path / "dumps"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.xml").write_text("<d>" + "".join(drug("<drug>", f"DB{k}{i}", "C") + "<drug/>" for i in range(k * 3)) + "</d>")
    parsed = sources.parse_drug_xml(spark, str(folder))
    assert sources.drugs_of(parsed).count() == 2 * 30
    assert [r.reason for r in sources.rejected_elements(parsed).collect()] == ["no primary id"] * 30


# --- JSON ---------------------------------------------------------------------------------------------------------

STRINGS = ["P1", 'q"uo{te', "back\\slash", "tail\\", "br}ace", "{", "}", "[,]", "é\n", "\\\"{", "x" * 700, ""]


def edges(seed, n=150):
    rng = random.Random(seed)
    made = [{"_id": {"$oid": str(i), "n": {"a": [{}]}}, "proteinAId": rng.choice(STRINGS), "proteinBId": f"P{i}", "score": i / 8} for i in range(n)]
    return made, sorted([(e["proteinAId"], e["proteinBId"], e["score"]) for e in made], key=repr)


@pytest.mark.parametrize("form", ["pretty", "compact", "lines", "line arrays", "ascii"])
def test_arrays_and_lines_over_ranges(spark, tmp_path, small_ranges, form):
    made, want = edges(3)
    file = tmp_path / "edges.json"
    dumped = [json.dumps(e, ensure_ascii=form == "ascii") for e in made]
    file.write_text({
        "pretty": "﻿" + json.dumps(made, indent=4, ensure_ascii=False) + "\n",
        "compact": json.dumps(made, separators=(",", ":"), ensure_ascii=False),
        "lines": "\n".join(dumped),
        "line arrays": "\n".join(f"[{a}, {b}]" for a, b in zip(dumped[::2], dumped[1::2])),
        "ascii": "[" + ",\n".join(dumped) + "]",
    }[form])
    assert rows(sources.read_ppi_json(spark, str(file))) == want
    assert rows(sources.read_ppi_json(spark, str(file), rejected=True)) == []


def test_an_array_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    made, _ = edges(4)
    file = tmp_path / "edges.json"
    file.write_text(json.dumps(made, indent=2))
    elements = sources.split_elements(spark, str(file), splitting.JSON_OBJECTS)
    whole = elements.collect()
    assert sorted(json.loads(r.element)["proteinBId"] for r in whole) == sorted(e["proteinBId"] for e in made)
    assert len(elements.inputFiles()) > 20  # one written file for each task that had rows


def test_broken_objects_are_rejected_with_a_reason(spark, tmp_path, small_ranges):
    good = '{"proteinAId": "P%d", "proteinBId": "Q", "score": %s}'
    parts = [
        good % (1, "1"), good % (2, '"0.5"'), good % (3, '"high"'), '{"proteinAId": "P4" "proteinBId": 1}', "17", "null",
        good % (5, "null"), '{"proteinAId": "P6"}', "{}", '{"a": {"b": 1}', 
    ]
    file = tmp_path / "edges.json"
    file.write_text("[" + ",\n".join(parts) + "]")
    got = rows(sources.read_ppi_json(spark, str(file)))
    assert got == sorted([("P1", "Q", 1.0), ("P2", "Q", 0.5), ("P5", "Q", None), ("P6", None, None), (None, None, None)], key=repr)
    rejected = [(r.reason, r.element) for r in sources.read_ppi_json(spark, str(file), rejected=True).collect()]
    assert sorted(reason for reason, _ in rejected) == ["not well formed"] * 3 + ["score is no double"]
    assert any("17, \nnull" in e.replace(",\n", ", \n") for _, e in rejected) and any(e.startswith('{"a"') for _, e in rejected)


def test_a_load_of_an_array_keeps_every_object(spark, tmp_path, small_ranges):
    file = tmp_path / "edges.json"
    made = [{"drugId": f"D{i}", "proteinId": "" if i % 10 == 0 else f"P{i}"} for i in range(100)]
    file.write_text(json.dumps(made, indent=1).replace('"D7"', '"D7'))
    loaded = etl.dti_json_to_table(spark, str(file), "dti_array", str(tmp_path / "bad"), path=str(tmp_path / "good"))
    assert loaded.good == spark.table("dti_array").count()
    assert spark.table("dti_array").columns == ["drugId", "proteinId"]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert loaded.bad == len(bad) and {r.reason for r in bad} == {"proteinId is blank", "not well formed"}
    text = "".join(r.element for r in bad)
    assert all(f'"D{i}' in text for i in (0, 7, 10, 90))
    spark.sql("DROP TABLE dti_array")


@pytest.mark.parametrize("grammar", [splitting.JSON_OBJECTS, splitting.xml_elements("drug")])
def test_notes_of_ranges_add_up(grammar):
    """Scanning a file in pieces, from the states of the pieces before, sees what one scan sees."""
    text = (json.dumps(edges(1)[0]) if grammar.separator == "{" else dump(1)[0]).encode()
    separator = grammar.separator.encode()
    events, state = grammar.scan(text, splitting.TEXT)
    cuts = [i for i in range(1, len(text)) if text[i : i + 1] == separator][::7]
    found, at, now = [], 0, splitting.TEXT
    for stop in [*cuts, len(text)]:
        more, now = grammar.scan(text[at:stop], now)
        found += [(a + at, b + at, step) for a, b, step in more]
        at = stop
    assert found == events and now == state
