import json

import pytest
from pyspark.sql import functions as F

from textloom import streaming
from textloom.operators import calibration, scope
from textloom.plans.queries import SHEET_RULES, model
from textloom.sources import readers, writers


def test_corpora(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"b": "zwei\nzeilen", "a": "é"}), encoding="utf-8")
    assert sorted(map(tuple, readers.corpus_json(spark, str(tmp_path / "c.json")).collect())) == [("a", "é"), ("b", "zwei\nzeilen")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/One.txt").write_bytes(b"line\nbad \xff byte")
    assert [tuple(r) for r in readers.corpus_texts(spark, str(tmp_path / "t")).collect()] == [("One", "line\nbad � byte")]
    readers.corpus_json(spark, str(tmp_path / "c.json")).write.parquet(str(tmp_path / "p"))
    assert readers.corpus_parquet(spark, str(tmp_path / "p")).count() == 2
    assert readers.first_existing(str(tmp_path / "no"), str(tmp_path / "c.json")) == str(tmp_path / "c.json")
    assert readers.first_existing(str(tmp_path / "no")) is None


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Filename,Cap,Cap-Answer,Law,Law- Answer,Free\nx.PDF,"[\'one, ""two""\', \'three\\n\']",Yes,,,\ny.pdf,"plain\ntext", No ,[],Ohio,z\n', encoding="utf-8")
    long = readers.annotations(readers.csv_table(spark, str(tmp_path / "a.csv")))
    got = {(r["name"], r["category"]): (r["spans"], r["answer"]) for r in long.collect()}
    assert got == {("x", "Cap"): (['one, "two"', "three\n"], "Yes"), ("x", "Law"): ([], None), ("y", "Cap"): (["plain\ntext"], "No"), ("y", "Law"): ([], "Ohio")}
    assert sorted((r["name"], r["category"], r["label"]) for r in readers.labels(long).collect()) == [("x", "Cap", True), ("x", "Law", False), ("y", "Cap", True), ("y", "Law", False)]
    named = spark.createDataFrame([("CAP!", 1)], "category string, n int")
    assert {r["category"]: r["n"] for r in readers.by_key(long, named).collect()} == {"Cap": 1, "Law": None}


def test_categories(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Category (incl. context and answer),Description,Answer Format,Group\nCategory: Parties,Description: Who signed,Answer Format: Names,Group: -\nCategory: Exclusivity,Description: x,Answer Format: ,Group: 2\n", encoding="utf-8")
    extra = spark.createDataFrame([("Parties", 3.5, "a note")], "category string, measured_pct double, note string")
    table = scope.categories(readers.category_table(spark, str(tmp_path / "d.csv")), extra)
    writers.categories_files(table, str(tmp_path / "out"))
    back = {c["category"]: c for c in json.loads((tmp_path / "out/categories.json").read_text())}
    assert back["Parties"] == {"category": "Parties", "description": "Who signed", "format": "Names", "group": "-", "bucket": "model", "closes_alone": True, "measured_pct": 3.5, "note": "a note"}
    read = {r["category"]: r for r in scope.config(spark, str(tmp_path / "out/categories.json")).collect()}
    assert (read["Parties"]["measured_pct"], read["Parties"]["bucket"], read["Exclusivity"]["note"], read["Exclusivity"]["closes_alone"]) == (3.5, "model", None, False)
    assert back["Exclusivity"]["format"] is None and back["Exclusivity"]["closes_alone"] is False
    assert (tmp_path / "out/categories.csv").read_text().splitlines()[0] == "category,format,group,bucket,closes_alone"
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        readers.category_table(spark, str(tmp_path / "e.csv"))


def test_model_and_calibration_files(spark, tmp_path):
    make = spark.createDataFrame
    tests = make([("A", 10, 4, 60.0, 80.0, 75.0, 70.0, 80.0, None)], "category string, n int, positives int, floor double, accuracy double, balanced double, recall double, specificity double, located_pct double")
    writers.model_file(make([("A", ["x", "y"]), ("B", [])], "category string, cues array<string>"), make([("A", 0.5), ("B", None)], "category string, threshold double"), tests, str(tmp_path / "m.json"))
    writers.calibration_file(make([("A", {0: 0.5, 3: 0.9}, 0.8)], "category string, bins map<int,double>, fallback double"), calibration.EDGES, str(tmp_path / "c.json"))
    got = {r["category"]: r for r in readers.model(spark, str(tmp_path / "m.json"), str(tmp_path / "c.json")).collect()}
    assert (got["A"]["cues"], got["A"]["threshold"], got["A"]["recall"], got["A"]["bins"], got["A"]["fallback"]) == (["x", "y"], 0.5, 70.0, {0: 0.5, 3: 0.9}, 0.8)
    assert (got["B"]["threshold"], got["B"]["recall"], got["B"]["bins"]) == (None, None, None)
    assert readers.model(spark, str(tmp_path / "m.json"), str(tmp_path / "none.json")).where("bins is null").count() == 2


def test_pages_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("n", "Law", "found"), ("m", "Law", "absent")], "name string, category string, state string")
    writers.sheet_file(rows, "n", str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"contract": "n", "rows": [{"category": "Law", "state": "found"}]}
    writers.page_file("<p>{{data}}</p>", str(tmp_path / "p.html"), data=[{"x": "</script>"}])
    assert (tmp_path / "p.html").read_text() == '<p>[{"x": "<\\/script>"}]</p>'
    with pytest.raises(ValueError, match="no"):
        writers.page_file("<p></p>", str(tmp_path / "p.html"), data=1)


def test_sheet_over_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "SUPPLY AGREEMENT\n\ngoverned by the laws of the State of Ohio") for i in range(6)], "name string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = streaming.sheet_stream(streaming.documents(spark, str(tmp_path / "in"), files_per_batch=1), SHEET_RULES, model(spark), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 * (len(SHEET_RULES) + 5)
    assert {r["value"] for r in got.where(F.col("category") == "Governing Law").collect()} == {"Ohio"}
