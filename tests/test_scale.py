"""What keeps the rules' time in proportion to the texts: each is read once, where it lies, and by cheap looks first."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions import law, location, parties, terms, text
from textloom.operators import measure, sheet, windows
from textloom.plans import queries

SF = "/root/testdata/sf0.001"
NOTES = "name string, category string, spans array<string>, answer string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_judged_rules_run_once_and_texts_stay(spark):
    """Spark asked of the filtered array first whether it was empty, by all rules anew; and the texts were shuffled to the answers."""
    docs = spark.createDataFrame([("a", "governed by the laws of the State of Texas.")], "name string, text string")
    notes = spark.createDataFrame([("a", "Governing Law", ["laws of the State of Texas"], "Texas")], NOTES)
    judged = measure.end_to_end(docs, notes)
    joined = plan(judged).split("Join Inner", 1)
    assert len(joined) == 2 and "govern(?:ed" not in joined[0] and "govern(?:ed" in joined[1]
    assert not re.search(r"Filter .*size\(", joined[0])
    assert [(r["category"], r["value"], r["correct"]) for r in judged.collect()] == [("Governing Law", "Texas", True)]


def test_scoped_sheet_reads_for_categories_in_scope_only(spark):
    """F2."""
    docs = spark.createDataFrame([("a", "governed by the laws of the State of Texas.")], "name string, text string")
    decided = spark.createDataFrame([("GOVERNING LAW.", True), ("Renewal Term", False)], "category string, in_scope boolean")
    rows = sheet.scoped(docs, queries.SHEET_RULES, queries.model(spark), decided)
    assert [(r["category"], r["value"]) for r in rows.collect()] == [("Governing Law", "Texas")]
    assert "successive" not in plan(rows)


def test_customers_are_spread(spark):
    """the customers' file was one task."""
    assert "RepartitionByExpression" in plan(queries.parties_located(spark, SF))


def test_windows_of_all_lists_equal_those_of_each(spark):
    """each window was cut from the text's start and its words compared with each list."""
    rng, words = random.Random(3), ["notice", "renewal", "laws", "the", "Norvex", "naïve", "😀", "x", "re-newal"]
    texts = [None, "", "notice", *(" ".join(rng.choice(words) if rng.random() < 0.1 else "filler" for _ in range(n)) for n in (3, 113, 114, 115, 400, 900))]
    cues = [["notice", "laws"], [], ["the", "renewal", "renewal"], None, ["absent"], ["re-newal"]]
    d = spark.createDataFrame([(t, cues) for t in texts], "text string, cues array<array<string>>")
    each = F.transform("cues", lambda c: windows.best_window(F.col("w"), c))
    got = d.withColumn("w", windows.windows(F.col("text"))).select(windows.best(F.col("text"), F.col("cues")).alias("all"), each.alias("each")).collect()
    assert [r["all"] for r in got] == [r["each"] for r in got]


def test_shorter_ways_find_the_same(spark):
    """The patterns that fail sooner, against the plain ones."""
    rng = random.Random(5)
    bits = ["two", "Twenty-four", "few", "(2)", "( 30 )", "12", "day", "days", "YEARS", "month", "week", "birthday", "oneyear", "x-two", "daylight", "-", " ", "\n", "_", "3a", "é", "notice"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    found = d.select(text.extract_all(F.col("t"), terms.TERM, 0).alias("a"), F.transform(text.matches(F.col("t"), terms.TERM_AT), lambda m: m["found"]).alias("b")).collect()
    assert sum(len(r["a"]) for r in found) > 1000 and all(r["a"] == r["b"] for r in found)

    places = spark.createDataFrame([(" ".join(rng.choice([*law.GAZETTEER, "indianapolis", "west", "new", "virginian"]) for _ in range(4)).lower(),) for _ in range(800)], "t string")
    plain = "(?i)" + "|".join(sorted(law.JURISDICTIONS)), r"(?i)\b(?:" + "|".join(law.JURISDICTIONS) + r")\b"
    ours = "(?i)" + text.any_of(sorted(law.JURISDICTIONS)), law.ANY
    assert all(r["a"] == r["b"] for p, o in zip(plain, ours) for r in places.select(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(o), F.lit(0)).alias("b")).collect())


def test_matches_are_placed_in_one_pass(spark):
    t = "a\x01b one\x02 Two one"
    d = spark.createDataFrame([(t,)], "t string")
    r = d.select(text.matches(F.col("t"), "(?i)one|two").alias("all"), text.matches(F.col("t"), "(?i)one|two", 2).alias("two")).first()
    assert [tuple(m) for m in r["all"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("(?i)one|two", t)]
    assert r["two"] == r["all"][:2]
    said = 'between Acme Corp ("A\x01B") and Norvex LLC ("Seller")'
    p = spark.createDataFrame([(said,), (said.replace("\x01", "x"),)], "t string").select(parties.parties_in(F.array("t")).alias("p")).collect()
    assert [r["p"] for r in p] == ['Acme Corp ("A\x01B"); Norvex LLC ("Seller")', 'Acme Corp ("AxB"); Norvex LLC ("Seller")']


def test_patterns_need_their_words():
    """Every anchor is guarded by words that stand in it."""
    for p in (*location.AGREEMENT_DATE, *location.EFFECTIVE_DATE, *(p for a in location.ANCHORS.values() for p in a)):
        assert location.NEEDS[p] and all(w == w.lower() and w in p.lower() for w in location.NEEDS[p])
