"""Entities found from anchors against a search of every pattern through the whole text."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketlake.functions import entities as en

PARTS = [
    "Act", "Act ", " Act", "Acts", "Labour", " the ", "of", " s", "s.", " s 12", "section ", " section 5A", "(2)", "(a)", "[Chapter 28:01]", "[", "]", "2025", "[2025] ", "ZWSC ", "1998 (2) ZLR 4", "S v ",
    " v ", " v. ", "v", "Shumba", "Ncube", "MOYO", " J", " JA", "J", "Justice ", "January", " May ", "21", "3/4/99", "1999-12-31", ", ", ". ", " ", "\n", " ", "é", "_", "Mpofu/12", "High Court of Zimbabwe", "  ", "x",
]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


def whole(text):
    """The same values with every pattern run over all of the text."""
    found = {
        "dates": sorted({en.iso_date(m.group()) for m in en._DATES.finditer(text)} - {""}),
        "statute_refs": sorted({en._groups(m) for m in en._STATUTES.finditer(text)} - {""}),
        "case_refs": sorted({en._groups(m) for m in en._CASES.finditer(text)} - {""}),
        "courts": [c for c in en.COURT_NAMES if c in text],
        "judges": sorted({" ".join(m.group().split(None)) for m in en._JUDGES.finditer(text)}),
        "parties": [p for m in en._PARTIES.finditer(text) if len(p := f"{m.group(1).strip()} v {m.group(2).strip()}") > 3],
    }
    return {k: v for k, v in found.items() if v}


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_anchors_lose_and_add_nothing(text):
    assert dict(en.find_entities(text)) == whole(text)


def test_long_texts_are_read_once_and_wholly():
    rng = random.Random(2)
    prose = " ".join(rng.choice(["word", "Action", "value", "over", "Judge", "sets", "Vs"]) for _ in range(60_000))
    text = f"{prose}. On 1/2/2020 MOYO JA cited section 12B of the Finance Act [Chapter 23:04]. {prose}. Shumba v Ncube, [2021] ZWHHC 7"
    found = dict(en.find_entities(text))
    assert found["dates"] == ["2020-02-01"] and found["judges"] == ["MOYO JA"] and found["case_refs"] == ["2021 ZWHHC 7"]
    assert "of the Finance 23:04" in found["statute_refs"] and "12B" in found["statute_refs"] and found["parties"][-1].endswith("Shumba v Ncube")


@pytest.mark.parametrize("raw, iso", [
    ("3/4/49", "2049-04-03"), ("3-4-50", "1950-04-03"), ("31 February 2020", "31 February 2020"), ("1  May\n2020", "2020-05-01"), ("May 1, 2020", "2020-05-01"), ("1999-12-31", "1999-12-31"), ("12/11/199", "12/11/199"),
])
def test_dates(raw, iso):
    assert en.iso_date(raw) == iso


def test_null_and_empty_texts_have_no_entities(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "s 5")], "id int, t string").withColumn("e", en.extract_entities("t"))
    assert {r.id: r.e for r in rows.collect()} == {1: {}, 2: {}, 3: {"statute_refs": ["5"]}}


def test_texts_go_to_python_in_arrow_batches(spark):
    plan = spark.range(5).select(en.extract_entities(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
