"""Dates in prose, written M/D/YY. No check against the calendar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import any_of, extract, first_of, has, let, or_null

# Months by the first letters of their names, and the date patterns, in order of priority. They look at a place's letter before they ask whether a word begins there, which costs more.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_MON = any_of(MONTHS)
ORDINAL = rf"(?i)(?=\d)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+day\s+of\s+({_MON})[a-z]*\.?,?\s*(\d{{4}})\b"
LONG = rf"(?i)(?=[jfmasond])\b({_MON})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})\b"
DAY_MONTH = rf"(?i)(?=\d)\b(\d{{1,2}})\s*(?:st|nd|rd|th|t\s*h)?\s*(?:day\s+of\s+)?({_MON})[a-z]*\.?,?\s*(\d{{4}})\b"
SLASHES = r"(?=\d)\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
FIRST_DATE = rf"(?i)((?:{_MON})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})"


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters."""
    return F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))[F.lower(F.left(name, F.lit(3)))]


def written(month: Column, day: Column, year: Column) -> Column:
    """M/D/YY; years above 100 lose their century."""
    return F.format_string("%d/%d/%02d", month.cast("int"), day.cast("int"), F.when(year > 100, year % 100).otherwise(year).cast("int"))


def _part(found: Column, pattern: str, group: int) -> Column:
    return extract(found, pattern, group)


def _number(found: Column, pattern: str, group: int) -> Column:
    return _part(found, pattern, group).try_cast("int")


def extract_date(text: Column) -> Column:
    """The first date of the first pattern that matches: ordinal, long, day and month, slashes.

    With slashes the first number is the month, unless it is above 12 and the second isn't. Null without a date.
    """
    def by_name(found: Column, pattern: str, day: int, month: int) -> Column:
        return F.when(found != "", written(month_number(_part(found, pattern, month)), _number(found, pattern, day), _number(found, pattern, 3)))

    def by_slashes(found: Column) -> Column:
        def ordered(p: Column) -> Column:
            swap = (p["a"] > 12) & (p["b"] <= 12)
            return written(F.when(swap, p["b"]).otherwise(p["a"]), F.when(swap, p["a"]).otherwise(p["b"]), p["year"])

        parts = F.struct(*(_number(found, SLASHES, g).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "year"))))
        return F.when(found != "", let(parts, ordered))

    # What a pattern can't match without is looked for first, as it costs less.
    named = [
        F.when(has(text, r"(?i)\sday\s+of\s"), let(extract(text, ORDINAL, 0), lambda m: by_name(m, ORDINAL, 1, 2))),
        let(extract(text, LONG, 0), lambda m: by_name(m, LONG, 2, 1)),
        let(extract(text, DAY_MONTH, 0), lambda m: by_name(m, DAY_MONTH, 1, 2)),
        F.when(F.contains(text, F.lit("/")), let(extract(text, SLASHES, 0), by_slashes)),
    ]
    return F.coalesce(*named)


def rule_date(fragments: Column) -> Column:
    return first_of(fragments, extract_date)


def naive_date(text: Column) -> Column:
    """The date at the first place where one is written."""
    return extract_date(or_null(extract(text, FIRST_DATE, 1)))
