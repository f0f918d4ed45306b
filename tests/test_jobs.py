"""Every job of the command line over a small corpus whose answers are known."""

import csv
import json
import random

import pytest

from textloom import __main__ as command, jobs
from textloom.operators import measure
from textloom.sources import readers

MONTH = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
INSURED = "The supplier maintains commercial general liability insurance with a policy limit and names the buyer as additional insured under each policy."
CAPPED = "The aggregate liability cap equals fees paid and neither side owes consequential damages beyond that limitation."
N = 100


def contract(i):
    """(name, text, spans, answers): dates in every fifth text stand too far behind to be located, and insurance follows in two of three."""
    kind, day, month, year = ("SUPPLY", "LICENSE", "SERVICE")[i % 3], i % 27 + 1, i % 12, 2000 + i % 20
    place = ("Ohio", "Delaware", "New York")[i % 3]
    written = f"{MONTH[month]} {day}, {year}"
    filler = "Further words follow about nothing in particular. " * (200 if i % 5 == 0 else 3)
    opening = f"{kind} AGREEMENT\n\n" + (filler if i % 5 == 0 else "") + f"This agreement is dated as of {written} by and between Acme {i} Trading Co (\"Buyer\") and Norvex Works LLC, a Delaware corporation (\"Seller\").\n\n"
    body = filler + (INSURED + "\n" if i % 3 else "") + (CAPPED + "\n" if i % 2 else "") + "It shall continue for 2 years and shall automatically renew for successive one (1) year terms unless notice of non-renewal is given 30 days prior to the end of the term.\n"
    law = f"This agreement shall be governed by the laws of the State of {place}.\n"
    spans = {
        "Document Name": [f"{kind} AGREEMENT"], "Parties": [f"Acme {i} Trading Co", "Norvex Works LLC"], "Agreement Date": [written], "Effective Date": [f"dated as of {written}"], "Governing Law": [law.strip()],
        "Expiration Date": ["shall continue for 2 years"], "Renewal Term": ["automatically renew for successive one (1) year terms"], "Notice Period To Terminate Renewal": ["notice of non-renewal is given 30 days prior"], "Insurance": [INSURED] if i % 3 else [], "Cap On Liability": [CAPPED] if i % 2 else [], "Free Text": [], "Never Answered": [],
    }
    short = f"{month + 1}/{day}/{year % 100:02d}"
    answers = {
        "Document Name": f"{kind} Agreement", "Parties": f"Acme {i} Trading Co (Buyer); Norvex Works LLC (Seller)", "Agreement Date": short, "Effective Date": "[* * *]" if i % 7 == 0 else short, "Governing Law": "Atlantis" if i == 4 else place,
        "Expiration Date": f"{month + 1}/{day}/{(year + 2) % 100:02d}", "Renewal Term": "1 year", "Notice Period To Terminate Renewal": "30 days", "Insurance": "Yes" if i % 3 else "No", "Cap On Liability": "Yes" if i % 2 else "No", "Free Text": "words", "Never Answered": "",
    }
    return f"ACME_{i:03d}_{kind.title()} Agreement", opening + body + law, spans, answers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("study")
    rows = [contract(i) for i in range(N)]
    random.Random(1).shuffle(rows)
    (top / "corpus.json").write_text(json.dumps({name: text for name, text, _, _ in rows}), encoding="utf-8")
    with (top / "clauses.csv").open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        names = list(rows[0][2])
        w.writerow(["Filename", *(c for n in names for c in (n, n + ("- Answer" if n == "Insurance" else "-Answer")))])
        for name, _, spans, answers in rows:
            w.writerow([name + ".PDF", *(c for n in names for c in (repr(spans[n]) if spans[n] else "", answers[n]))])
        w.writerow(["Not there.pdf", *[""] * (2 * len(names))])
    return top


@pytest.fixture(scope="module")
def study(spark, folder):
    s = jobs.Study(spark, f"{folder}/corpus.json", f"{folder}/clauses.csv", f"{folder}/model.json", f"{folder}/calibration.json")
    s.trained = jobs.train(s, s.model_path)
    s.fitted_tables = jobs.calibrate(s, s.fitted)
    return s


def table(df, key="category"):
    return {r[key]: r for r in df.collect()}


def test_training_learns_the_clauses_and_writes_the_model(study, folder):
    rows, summary = study.trained
    got = table(rows)
    assert set(got) == {"Insurance", "Cap On Liability"} and all(r["balanced"] == 100.0 and r["n"] == 20 for r in got.values())
    # the window of the best score holds the passage's beginning, unless the text before it is long
    assert all(r["located_pct"] > 0 for r in got.values())
    assert [r["category"] for r in rows.collect()] == ["Cap On Liability", "Insurance"]
    assert summary.first()["not_measured"] == "Never Answered" and summary.first()["above_55"] == 2
    model = json.loads((folder / "model.json").read_text())
    assert "insured" in model["cues"]["Insurance"] and model["cues"]["Never Answered"] == [] and model["thresholds"]["Never Answered"] is None
    assert [r["category"] for r in model["test"]] == ["Cap On Liability", "Insurance"]


def test_calibration_writes_bands_in_scope(study, folder):
    bands, errors = study.fitted_tables
    assert set(table(bands)) == {"Insurance", "Cap On Liability"} and tuple(errors.first()) == (0.0, 0.0)
    fitted = json.loads((folder / "calibration.json").read_text())
    assert set(fitted) == {"Insurance", "Cap On Liability"} and fitted["Insurance"]["fallback"] == 1.0 and fitted["Insurance"]["edges"] == [0.0, 0.02, 0.05, 0.1, 1.0]


def test_floor_report_has_its_form_and_order(study, folder):
    report, summary = jobs.floor(study, f"{folder}/floor.csv")
    lines = (folder / "floor.csv").read_text().splitlines()
    assert lines == ["category,si,no,total,trivial_floor_pct,majority_class,valid_metric,human_confirmations", "Insurance,66,34,100,66.0,Yes,recall_clase_minoritaria,34", "Cap On Liability,50,50,100,50.0,Yes,accuracy,50"]
    assert summary.first()["categories"] == 2 and summary.first()["confirmations"] == 84


def test_rules_over_passages_and_over_texts(study):
    rows, failures = jobs.rules(study)
    got = table(rows)
    assert set(got) == {c for c, *_ in measure.RULES}
    assert all(r["right"] == r["n"] for c, r in got.items() if c != "Governing Law") and (got["Governing Law"]["right"], got["Governing Law"]["n"]) == (99, 100)
    assert got["Effective Date"]["n"] == 100 - 15 and failures.count() == 0  # redacted answers can't be judged; law stands above 95 %
    whole, lost = jobs.end_to_end(study)
    got = table(whole)
    assert lost.first()["unmatched"] == 1 and "Expiration Date" not in got
    # dates that stand behind the front matter aren't located
    assert (got["Agreement Date"]["n"], got["Agreement Date"]["pct"], got["Agreement Date"]["located_pct"], got["Agreement Date"]["cost"]) == (100, 80.0, 100.0, -20.0)
    assert all(got[c]["cost"] == 0 for c in ("Document Name", "Governing Law", "Renewal Term", "Notice Period To Terminate Renewal"))


def test_scope_sheet_bias_and_baseline(study, folder):
    (decided,) = jobs.scope_lists(study)
    got = [(r["category"], r["in_scope"]) for r in decided.collect()]
    assert {c for c, ok in got if ok} >= {"Document Name", "Governing Law", "Agreement Date", "Insurance", "Cap On Liability"}
    measures = [r["measure"] for r in decided.where("in_scope").collect()]
    assert measures == sorted(measures, reverse=True)
    rows, summary, tenths = jobs.whole_sheet(study)
    held = [contract(i) for i in range(80, 100)]
    late = sum(i % 5 == 0 for i in range(80, 100))
    got = table(rows)
    assert got["Agreement Date"]["n"] == 20 and got["Agreement Date"]["right"] == 20 - late and got["Insurance"]["pct"] == 100.0
    assert summary.first()["sheets"] == len(held) and sum(r["sheets"] for r in tenths.collect()) == len(held)
    types, gaps, quarters, _ = jobs.bias(study)
    assert sorted(r["grp"] for r in types.collect()) == ["LICENSE AGREEMENT", "SERVICE AGREEMENT", "SUPPLY AGREEMENT"] and {r["grp"] for r in quarters.collect()} == {"Q1", "Q2", "Q3", "Q4"}
    assert not any(r["gap"] for r in gaps.collect())
    rows, means = jobs.baseline(study, f"{folder}/baselines.csv")
    got = table(rows)
    assert got["Insurance"]["naive"] == pytest.approx(35) and got["Insurance"]["gain"] == pytest.approx(65) and got["Document Name"]["naive"] == 100.0
    assert means.first()["gain"] == pytest.approx(sum(r["gain"] for r in got.values()) / len(got))
    # with baselines known, what doesn't beat them is out
    strict = jobs.Study(study.spark, study.corpus, study.csv, study.model_path, study.fitted, f"{folder}/baselines.csv")
    assert not table(strict.scope())["Document Name"]["in_scope"] and table(strict.scope())["Insurance"]["in_scope"]


def test_page_holds_rows_ranges_and_lists(study, folder):
    names = jobs.build_page(study, f"{folder}/page.html", ["1", "ACME_002"], add=["3"], remove=["1"])
    assert names == ["ACME_002_Service Agreement", "ACME_003_Supply Agreement"]
    html = (folder / "page.html").read_text()
    data = json.JSONDecoder().raw_decode(html.split("const data = ")[1])[0]
    rows = {r["category"]: r for r in data[0]["rows"]}
    assert data[0]["text"][slice(*rows["Agreement Date"]["range"])] == "March 3, 2002" and rows["Governing Law"]["value"] == "New York"
    assert rows["Insurance"]["state"] == "found" and rows["Insurance"]["passage"].startswith("SERVICE AGREEMENT This") and rows["Insurance"]["depth"] == 0
    assert rows["Document Name"]["confidence"] == rows["Document Name"]["clause_accuracy"] and data[0]["length"] == len(contract(2)[1])
    assert "{{" not in html and "Built " in html
    with pytest.raises(LookupError):
        jobs.build_page(study, f"{folder}/page.html", ["1"], remove=["1"])


def test_every_command_runs(study, folder, capsys, monkeypatch):
    corpus, notes = ["--corpus", f"{folder}/corpus.json"], ["--annotations", f"{folder}/clauses.csv"]
    model = ["--model", f"{folder}/model.json", "--calibration", f"{folder}/calibration.json"]
    (folder / "descriptions.csv").write_text("Category,Description,Format,Group\nCategory: Parties,Description: x,Answer Format: y,Group: 1\n")
    for argv in (["floor", *notes], ["rules", *notes], ["e2e", *corpus, *notes], ["scope", *corpus, *notes, *model], ["sheet", *corpus, *model, "5"], ["page", *corpus, *notes, *model, "--list"], ["categories", f"{folder}/descriptions.csv", f"{folder}/table"]):
        command.main(argv)
    said = capsys.readouterr().out
    assert "ACME_005_Service Agreement" in said and "held out  ACME_099" in said and "wrong number" in said and "Governing Law" in said


def test_readers_as_training_and_keys_ask(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Filename,Cap on Liability,Cap On Liability-Answer,Law,Law-Answer\nx.pdf,'ab',Yes,\"('c', 'd')\",\n", encoding="utf-8")
    wide = readers.csv_table(spark, str(tmp_path / "a.csv"))
    spans = lambda **how: {r["category"]: r["spans"] for r in readers.annotations(wide, **how).collect()}
    assert spans() == {"Law": ["('c', 'd')"]} and spans(match_keys=True) == {"Cap on Liability": ["ab"], "Law": ["('c', 'd')"]}
    assert spans(match_keys=True, training=True) == {"Cap on Liability": ["a", "b"], "Law": ["c", "d"]}
