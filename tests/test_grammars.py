"""Grammars of entries, names of agents and citations against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from curalake.functions import agents as A
from curalake.functions import omics as O
from curalake.functions import text as T
from curalake.functions import wording as W


def values(spark, column, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", column(F.col("c")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def cut(text, separator):
    """By letters, keeping the depth."""
    out, depth = [""], 0
    for ch in text:
        depth = depth + 1 if ch == "(" else max(0, depth - 1) if ch == ")" else depth
        if ch == separator and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def random_texts(n=400):
    rng = random.Random(7)
    return ["".join(rng.choice("ab ():,*;") for _ in range(rng.randrange(24))) for _ in range(n)] + ["", "(", ")", "((,)),", "," * 3000]


def test_top_level(spark):
    texts = random_texts()
    assert values(spark, lambda c: T.top_level(c, ","), texts) == [cut(t, ",") for t in texts]
    assert values(spark, lambda c: T.top_level(c, ":"), [None]) == [None]


def test_entries_by_letters(spark):
    texts = random_texts()
    for text, e in zip(texts, values(spark, O.entry, texts)):
        kind, _, detail = text.partition(";")
        first, *rest = cut(detail.strip(), ":")
        items = [(x.replace("*", "").strip(), "*" in x) for x in cut(":".join(rest) if rest else first, ",")]
        assert e.type == kind.replace("*", "").strip()
        assert e.biomarker == (first.replace("*", "").strip() or None if rest else None)
        assert [(i.text, i.colocalized) for i in e["items"]] == [i for i in items if i[0]]


@pytest.mark.parametrize(
    "biomarker,items,wire,label",
    [
        (None, [], "T", "T"),
        ("A", [], "T;A", "T (A)"),
        (None, [("one", True), ("two", False)], "T;one*, two", "T (one, two)"),
        ("A", [("one, two", True), ("three (left, right)", False)], "T;A: one*, two*, three (left, right)", "T (A: one, two, three (left, right))"),
        (None, [("S: one", True)], "T;: S: one*", "T (S: one)"),
        ("A: total", [("one", True)], "T;A, total: one*", "T (A, total: one)"),
        (":", [("one", False)], "T;one", "T (one)"),
        ("A (part: one", [("one", True)], "T;A part, one: one*", "T (A part, one: one)"),
        ("A*; b", None, "T;A, b", "T (A, b)"),
        ("[?]", [("x", False)], "T;[?]: x", "T (?: x)"),
    ],
)
def test_wire(spark, biomarker, items, wire, label):
    df = spark.createDataFrame([("T", biomarker, items)], f"t string, b string, i array<{O.ITEM}>")
    row = df.select(O.to_wire(F.col("t"), F.col("b"), F.col("i")).alias("w")).select("w", O.label(O.entry(F.col("w"))).alias("l")).first()
    assert (row.w, row.l) == (wire, label)


def test_stored_cells(spark):
    df = spark.createDataFrame([(["a;b", 'q"x', "é"],), ([],)], "e array<string>").select("e", O.stored(F.col("e")).alias("s"))
    for e, s in df.collect():
        assert ";" not in s and values(spark, O.cell_entries, [s]) == [e]
    assert values(spark, O.cell_entries, ["x; [1 ;x;", None, "[null]"]) == [["x", "[1"], [], ["[null]"]]


NAMES = {
    "Atorvastatin 40 Mg Oral Tablet": "Atorvastatin",
    "Tenecteplase 0.25 mg/kg": "Tenecteplase",
    "Hypertonic saline 3%": "Hypertonic saline",
    "Aspirin 100 mg/dipyridamole 200 mg": "Aspirin and dipyridamole",
    "Triple Pill": "Triple Pill",
    "Samplitong (lyophilized) for injection": "Samplitong (lyophilized)",
    "very high dose group of SaiLuoTong capsule": "SaiLuoTong",
    "rt-PA": "rt-PA",
    "aspirin and SaiLuoTong capsule": "Aspirin and SaiLuoTong",
    "Valproate sodium": "Valproate sodium",
    "NACA": "NACA",
    "N Acetylcysteine": "Acetylcysteine",
    "(ABC-XYZ)": "(ABC-XYZ)",
    "donepezil hydrochloride (Aricept)": "Donepezil",
    "BAC treatment": "BAC",
    "Regular treatment": None,
    "Amlodipine+intensive antihypertensive therapy": "Amlodipine",
    "telmisartan 20 mg + amlodipine 2.5mg +indapamide 1.25mg": "Telmisartan, amlodipine and indapamide",
    "+++": None,
    "  ": None,
    "": None,
    None: None,
}


def test_agent_names(spark):
    assert dict(zip(NAMES, values(spark, A.agent_name, NAMES))) == NAMES
    once = [n for n in NAMES.values() if n and " and " not in n]
    assert values(spark, A.agent_name, once) == once


def test_citations(spark):
    lists = ["Mishra A, Malik R, et al.", "MEGASTROKE Consortium", "De Silva", "Smith J.-P.", "", " , x", None]
    shown = values(spark, lambda c: W.short_citation(c, F.lit("Nature (Nov 2022)"), F.lit(7)), lists)
    assert shown == ["Mishra, A., et al. (2022)", "MEGASTROKE Consortium (2022)", "De Silva (2022)", "Smith, J. (2022)", "PMID 7", "PMID 7", "PMID 7"]
    assert values(spark, W.citation_year, ["2022", "x12022", "1799 1899", None]) == ["2022", None, "1899", None]
    lines = values(spark, lambda c: F.transform(W.citation_lines(c), lambda x: F.concat_ws("=", x["label"], x["value"])), ["<b>A &amp;lt; B</b><br/><i>T</i><BR>J<br>doi: 1", "x<br><br>y", "", None])
    assert lines == [["Authors=A &lt; B", "Title=T", "Journal=J", "DOI=1"], ["Reference=x y"], ["Reference="], None]
