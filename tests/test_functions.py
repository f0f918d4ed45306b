"""Hand-made cases for every column function."""

import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import compare, dates, law, location, parties, terms, text, titles


@pytest.fixture(scope="module")
def ev(spark):
    def run(function, *values):
        kinds = ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values))
        return spark.createDataFrame([values], kinds).select(function(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()["r"]

    return run


@pytest.mark.parametrize(
    ("said", "date"),
    [
        ("5th day of May, 2019", "5/5/19"), ("May 3, 2016", "5/3/16"), ("1 August 2019", "8/1/19"), ("20t h day of November, 2018", "11/20/18"), ("29/3/18", "3/29/18"), ("99/99/2020", "99/99/20"),
        ("May 3, 2016 and 4th day of June, 2017", "6/4/17"), ("13/13/13", "13/13/13"), ("Sept. 9 1999", "9/9/99"), ("no date", None), ("", None), (None, None),
    ],
)
def test_dates(ev, said, date):
    assert ev(dates.extract_date, said) == date


def test_date_of_fragments(ev):
    assert ev(dates.rule_date, ["x", "May 3, 2016", "May 4, 2017"]) == "5/3/16"
    assert ev(dates.rule_date, []) is None
    assert ev(dates.naive_date, "on 1/2/03 or May 3, 2016") == "1/2/03"


@pytest.mark.parametrize(
    ("said", "units", "term"),
    [
        ("two (2) years", ("year",), "2 years"), ("thirty (30) business days", ("day",), None), ("1 day", ("day",), "1 day"), ("zero 0 days then 5 weeks", ("day", "week"), "5 weeks"),
        ("twenty-four months", ("month",), "24 months"), ("seventeen days", ("day",), None), ("2 years 3 months", ("month",), "3 months"), (None, ("day",), None),
    ],
)
def test_terms(ev, said, units, term):
    assert ev(lambda c: terms.term_in(c, *units), said) == term


def test_terms_near_words(ev):
    near = lambda c: terms.term_near(c, ("day",), ("notice",))
    assert ev(near, "5 days " + "x" * 200 + " notice") is None
    assert ev(near, "5 days for notice 6 days") in ("5 days", "6 days")
    assert ev(near, "aa 3 days bb notice cc 4 days") == "3 days"
    assert ev(near, "1 day notice") == "1 day"
    assert ev(terms.rule_renewal, ["in perpetual force", "renew for 2 years"]) == "perpetual"
    assert ev(terms.rule_renewal, ["nothing", "shall renew for one (1) year; first 5 years"]) == "1 year"
    assert ev(terms.rule_notice, ["after 9 days", "notice of 2 months"]) == "2 months"
    assert ev(terms.rule_notice, ["after 9 days", "x"]) == "9 days"


@pytest.mark.parametrize(
    ("said", "effective", "ends"),
    [
        ("for one (1) month", "1/31/20", "2/28/20"), ("for 1 month", "3/31/20", "4/28/20"), ("for 5 years", "3/31/70", "3/31/75"), ("for 2 years", "2/29/20", "2/28/22"), ("for 4 years", "2/29/20", "2/29/24"),
        ("until the end of the then current calendar year", "3/1/09", "12/31/09"), ("until May 3, 2016", None, "5/3/16"), ("until May 3, 2016", "1/1/15", "5/3/16"), ("term of 13 months", "12/5/99", "1/5/01"),
        ("for 0 (0) years until 1/2/03", "1/1/01", "1/2/03"), ("nothing", "1/1/01", None),
    ],
)
def test_expiration(ev, said, effective, ends):
    assert ev(lambda f, e: terms.rule_expiration(f, e), [said], effective) == ends


def test_days(ev):
    assert [ev(terms.to_days, x) for x in ("1 year", "12 months", "2 weeks", "3 day", "no", None)] == [365, 360, 14, 3, None, None]


def test_law(ev):
    assert ev(law.rule_law, ["governed by the laws of the State of New York and so on"]) == "New York"
    assert ev(law.rule_law, ["laws of Texas", "in West Virginia"]) == "West Virginia"
    assert ev(law.rule_law, ["the laws of the State of Atlantis, near Ohio"]) == "Ohio"
    assert ev(law.rule_law, ["indianapolis"]) is None
    assert ev(law.naive_law, "Indianapolis in ohio") == "India"
    assert ev(law.naive_law, "nowhere") is None
    assert len(law.JURISDICTIONS) == len(set(law.JURISDICTIONS)) == 98
    ends = {j.split()[-1] for j in law.JURISDICTIONS if " " in j}
    assert not any(j.split()[0] in ends for j in law.JURISDICTIONS if " " in j)


def test_titles(ev):
    assert ev(titles.located_title, "Exhibit 10.4\n\nSUPPLY AGREEMENT dated\n\nmore") == ["SUPPLY AGREEMENT"]
    assert ev(titles.located_title, "Hello there my friend\nThis Supply Agreement is good") == ["SUPPLY AGREEMENT"]
    assert ev(titles.located_title, "Quite a Lease of things\nALL CAPITALS HERE") == ["Quite a Lease"]
    assert ev(titles.located_title, "ALL CAPITALS HERE\nlower text") == ["ALL CAPITALS HERE"]
    assert ev(titles.located_title, "short\n") == ["short"]
    assert ev(titles.located_title, "") == [""]
    assert [ev(titles.plausible_title, x) for x in ("a\x01bcdefghij", "short", "12345678901", "<b>Agreement</b>", None, "x" * 201, "a b c d e f")] == ["abcdefghij", None, None, None, None, None, None]
    assert ev(titles.naive_title, "\n  \r\n x y \nz") == "x y"
    assert ev(titles.rule_title, []) is None


def test_parties(ev):
    said = 'this is by and between Acme Systems, a Delaware corporation ("Company") and Foo Bar LLC (the) and Norvex Ltd (“Seller”)\n\nmore'
    assert ev(parties.parties_in, [said]) == 'Acme Systems ("Company"); Foo Bar LLC ("the"); Norvex Ltd ("Seller")'
    assert ev(parties.parties_in, [said, 'and Later One ("X")']).count(";") == 2
    assert ev(parties.parties_in, ['and Only One ("X")', 'and Later One ("Y")']) == 'Only One ("X"); Later One ("Y")'
    assert ev(parties.parties_in, ['the Widget ("Products")', ""]) is None
    assert ev(parties.rule_parties, ["Acme Inc", " ACME, INC. ", "Foo Ltd", "ab"]) == "Acme Inc; Foo Ltd"
    assert ev(parties.strip_description, "Acme, a Delaware corporation") == "Acme"


def test_comparison(ev):
    assert ev(compare.same_text, "A-b  c", "a b C!") and not ev(compare.same_text, "a", None)
    assert ev(compare.same_date, "5/3/16", "May 3, 2016") and not ev(compare.same_date, None, "May 3, 2016")
    assert ev(compare.same_contains, "Ohio", "State of ohio") and ev(compare.same_contains, "2 weeks", "14 days") and not ev(compare.same_contains, "1 year", "12 months")
    assert ev(compare.same_parties, "A One; B Two", "b two (x); C; a one") and not ev(compare.same_parties, "A One", "b two; a one") and ev(compare.same_parties, "x; A One", "A one")
    assert [ev(compare.judgeable, x) for x in ("[* * *]", " ", None, "x", "[]/[]")] == [False, False, False, True, False]


def test_location(ev):
    assert ev(lambda c: location.fragments("governing law", c), "x" * 500 + "governed by law" + "y" * 1300) == ["x" * 400 + "governed by law" + "y" * 1196]
    assert ev(location.agreement_date, "a" * 30) == ["a" * 30]
    assert ev(location.agreement_date, "dated as of 1/2/03") == ["dated as of 1/2/03"]
    assert len(ev(location.effective_date, "The Effective Date is 1/2/03. " * 20)) == 8
    assert ev(lambda c: location.fragments("insurance", c), "insurance") == []
    assert ev(location.parties, "between " + "a" * 40 + " witnesseth")[0].strip() == "a" * 40
    assert ev(lambda c: location.fragments("governing law", c), "applicable law " * 20).__len__() == 6


def test_text(ev):
    t = "😀 one😀two one"
    assert [tuple(m) for m in ev(lambda c: text.matches(c, "one|two"), t)] == [(m.start(), m.end(), m.group()) for m in re.finditer("one|two", t)]
    assert ev(text.window_starts, "x" * 2000) == [0, 800, 1600]
    assert ev(text.window_starts, "") == [0]
    assert ev(text.key_of, "Cap on-Liability (1)!") == "cap onliability 1"
    assert ev(text.stem, "a.PDF") == "a" and ev(text.stem, "pdf") == "pdf"
    assert ev(text.strip_prefix, "Answer Format: Yes/No ") == "Yes/No"
    assert sorted(ev(text.word_set, "The party's non-compete AND all ab abc")) == ["abc", "non-compete", "party's"]


ADVERSARIAL = ["a" * 60_000, "laws of the State of " + "New " * 4000, "dated as of " + "1 " * 20_000, " " * 50_000 + "AGREEMENT", "(" * 5000 + ")" * 5000, 'x ("' * 8000, "1 day of January, 2020 " * 3000]


def test_no_pattern_takes_long_on_adversarial_texts(spark):
    whole = [dates.ORDINAL, dates.LONG, dates.DAY_MONTH, dates.SLASHES, terms.TERM, terms.TERM_OF, law.PHRASE, law.ANY, location.BETWEEN, titles.IN_BODY, *(f"(?id){p}" for ps in location.ANCHORS.values() for p in ps), *(f"(?id){p}" for p in (*location.AGREEMENT_DATE, *location.EFFECTIVE_DATE))]
    field = [parties.DESCRIPTION, parties.NO_PARTY, titles.BOILERPLATE, titles.KIND]
    df = spark.createDataFrame([(t,) for t in ADVERSARIAL], "t string").coalesce(1).cache()
    df.count()
    for patterns, source in ((whole, F.col("t")), (field, F.left("t", F.lit(200))), ([parties.NAME_WITH_ALIAS], F.left("t", F.lit(4000)))):
        for p in patterns:
            began = time.time()
            df.select(F.sum(F.regexp_count(source, F.lit(p)))).collect()
            assert time.time() - began < 10, p


def test_classes_of_unicode_are_an_option(spark):
    said = "dated as of January\u00a05,\u00a02015 under the laws\u00a0of the State\u00a0of New\u00a0York"
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(dates.extract_date(F.col("t"))).first()[0] is None
    with text.unicode_classes():
        row = df.select(dates.extract_date(F.col("t")), F.size(location.fragments("agreement date", F.col("t"))), F.size(location.fragments("governing law", F.col("t")))).first()
    assert tuple(row) == ("1/5/15", 1, 1)
    assert df.select(dates.extract_date(F.col("t"))).first()[0] is None


def test_titles_in_the_body_pass_carriage_returns(spark):
    said = "12\n" + "this supply\ragreement is made between the parties"
    assert spark.createDataFrame([(said,)], "t string").select(titles.located_title(F.col("t"))).first()[0] == ["SUPPLY\rAGREEMENT"]
