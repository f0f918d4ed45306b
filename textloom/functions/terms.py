"""Terms such as "two (2) years", as "2 years"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.dates import extract_date, written
from textloom.functions.text import extract, first_of, has, holds, let, matches, or_null, split

# Number words, the shapes of a term, days of a unit, and the words near which a term counts.
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "sixty": 60, "ninety": 90,
    "hundred": 100, "eighteen": 18, "twenty-four": 24, "thirty-six": 36,
}
TERM = r"(?i)\b(?:(\d+)|([a-z]+(?:-[a-z]+)?))\s*(?:\(\s*(\d+)\s*\))?\s*(day|week|month|year)s?\b"
#: Finds what TERM finds, and sooner what isn't a term: a word at a term's place is followed by a unit's first letter or a parenthesis, or goes on with a hyphen, or ends in a unit itself.
TERM_AT = TERM.replace(r"\b(?:", r"\b(?=\d|[a-z]++(?:\s*+[(dwmy]|-|(?<=[ykhrs])(?<=(?:day|week|month|year)s?)))(?:", 1)
TERM_OF = r"(?i)(?:for|of|continue[sd]?\s+for|period\s+of|term\s+of)\s+(?:a\s+)?(?:(\d+)|([a-z]+(?:-[a-z]+)?))\s*(?:\(\s*(\d+)\s*\))?\s*(month|year)s?\b"
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
RENEWAL_WORDS = ("renew", "extend", "successive", "additional term")
NOTICE_WORDS = ("notice", "non-?renewal", "notif", "prior to the (?:end|expir)")
NEAR = 160
#: Words without which the words above that are patterns can't match.
NEEDS = {"additional term": ("additional term",), "non-?renewal": ("renewal",), "prior to the (?:end|expir)": ("prior to the ",)}


def number_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))


def _count(found: Column, pattern: str) -> Column:
    """Digits in parentheses, else digits, else the number word; null if unknown."""
    part = lambda g: extract(found, pattern, g)
    digits = F.when(part(3) != "", part(3)).otherwise(part(1))
    return F.coalesce(digits.try_cast("bigint"), number_map()[F.lower(part(2))].cast("bigint"))


def _said(n: Column, unit: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n != 1, "s").otherwise(""))


def terms(text: Column, *units: str) -> Column:
    """All terms in one of the units (in any without) with a known number other than zero: an array of (start, unit, said), in text order."""
    units = units or tuple(DAYS)

    def unit(found: Column) -> Column:
        """The unit asked for that a match ends in, be it plural or not; null for another."""
        end = F.rtrim(F.lower(found), F.lit("sſ"))
        return F.coalesce(*(F.when(F.endswith(end, F.lit(u)), u) for u in units))

    ours = F.filter(F.transform(matches(text, TERM_AT), lambda m: F.struct(m["start"].alias("start"), unit(m["found"]).alias("unit"), m["found"].alias("found"))), lambda t: t["unit"].isNotNull())
    read = F.transform(ours, lambda t: F.struct(t["start"].alias("start"), t["unit"].alias("unit"), _count(t["found"], TERM).alias("n")))
    known = F.filter(read, lambda t: t["n"].isNotNull() & (t["n"] != 0))
    return F.transform(known, lambda t: F.struct(t["start"].alias("start"), t["unit"].alias("unit"), _said(t["n"], t["unit"]).alias("said")))


def term_in(text: Column, *units: str) -> Column:
    """The first term in one of the units."""
    return F.get(terms(text, *units), F.lit(0))["said"]


def term_near(text: Column, units: tuple[str, ...], words: tuple[str, ...], window: int = NEAR) -> Column:
    """The term that starts nearest to one of the words, at most ``window`` characters away; of equals the earlier."""
    def starts(w: str) -> Column:
        needed = NEEDS.get(w, (w.lower(),) if w.isalpha() else ())
        return F.when(holds(F.lower(text), needed), F.transform(matches(text, f"(?i){w}"), lambda m: m["start"])).when(text.isNotNull(), F.array().cast("array<int>"))

    anchors = F.flatten(F.array(*(starts(w) for w in words)))

    def near(x: Column) -> Column:
        def placed(t: Column) -> Column:
            away = F.array_min(F.transform(x["anchors"], lambda a: F.abs(t["start"] - a)))
            return F.struct(away.alias("away"), t["start"].alias("start"), t["said"].alias("said"))

        return F.array_min(F.filter(F.transform(x["ours"], placed), lambda p: p["away"] <= window))["said"]

    # Both are read once a text, and outside of the functions: a function within a function takes long to analyse.
    return let(F.struct(anchors.alias("anchors"), terms(text, *units).alias("ours")), near)


def rule_renewal(fragments: Column) -> Column:
    def one(f: Column) -> Column:
        return F.when(F.contains(F.lower(f), F.lit("perpetual")) & has(f, r"(?i)\bperpetual\b"), F.lit("perpetual")).otherwise(F.coalesce(term_near(f, ("year", "month"), RENEWAL_WORDS), term_in(f, "year", "month")))

    return first_of(fragments, one)


def rule_notice(fragments: Column) -> Column:
    near = first_of(fragments, lambda f: F.coalesce(term_near(f, ("day",), NOTICE_WORDS), term_near(f, ("month",), NOTICE_WORDS)))
    return F.coalesce(near, first_of(fragments, lambda f: term_in(f, "day")))


def _days_in_month(month: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def rule_expiration(fragments: Column, effective: Column) -> Column:
    """The end date: effective date (M/D/YY) plus the term, or the end of its year, or else a date that is written.

    Years below 70 are of this century. A day that the month doesn't have becomes the 28th.
    """

    def ended(x: Column) -> Column:
        """x: text, found (its term), month, day, year of the effective date."""
        return let(F.struct(_count_or_word(x["found"]).alias("n"), F.lower(extract(x["found"], TERM_OF, 4)).alias("unit")), lambda t: F.when(t["n"].isNotNull() & (t["n"] != 0), _moved(x, t)).otherwise(extract_date(x["text"])))

    def at(i: int) -> Column:
        return F.get(split(effective, "/"), F.lit(i)).try_cast("int")

    def whole(text: Column) -> Column:
        parts = F.struct(text.alias("text"), or_null(extract(text, TERM_OF, 0)).alias("found"), at(0).alias("month"), at(1).alias("day"), at(2).alias("year"))
        calendar = has(text, r"(?i)end of the (?:then[- ])?current calendar year")
        known = effective.isNotNull() & (effective != "")
        return F.when(known & calendar, F.format_string("12/31/%02d", at(2))).when(known, let(parts, ended)).otherwise(extract_date(text))

    return let(F.array_join(fragments, " "), whole)


def _moved(x: Column, t: Column) -> Column:
    """The date x moved by the term t."""
    year, months = x["year"] + F.when(x["year"] < 70, 2000).otherwise(1900), x["month"] - 1 + t["n"]
    by_year = t["unit"] == "year"
    to = F.struct(F.when(by_year, x["month"]).otherwise((months % 12 + 1).cast("int")).alias("month"), F.when(by_year, year + t["n"]).otherwise(year + F.floor(months / 12)).alias("year"))

    def checked(d: Column) -> Column:
        valid = d["month"].between(1, 12) & (x["day"] >= 1) & (x["day"] <= _days_in_month(d["month"], d["year"])) & d["year"].between(1, 9999)
        return written(d["month"], F.when(valid, x["day"]).otherwise(28), d["year"])

    return let(to, checked)


def _count_or_word(found: Column) -> Column:
    """As ``_count``, but digits that say zero leave the word a chance."""
    part = lambda g: or_null(extract(found, TERM_OF, g))
    digits = F.coalesce(part(3), part(1)).try_cast("bigint")
    return F.coalesce(F.nullif(digits, F.lit(0).cast("bigint")), number_map()[F.lower(part(2))].cast("bigint"))


def to_days(text: Column) -> Column:
    """Days of the first "number unit" with digits; a year has 365, a month 30."""
    pattern = r"(?i)\b(\d+)\s*(day|week|month|year)s?\b"
    days = F.create_map(*(F.lit(x) for pair in DAYS.items() for x in pair))
    n = or_null(extract(text, pattern, 1)).try_cast("bigint")
    return n * days[F.lower(or_null(extract(text, pattern, 2)))]
