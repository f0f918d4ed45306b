"""Fragments of a document in which a clause's value stands.

A category without a strategy has no fragments: the whole text would let any rule find something.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import extract_all, holds, matches, strip
from textloom.functions.titles import located_title

# Sizes in characters, and the anchors in their order.
FRONT, AFTER, BEFORE, AFTER_DATE, BEFORE_EFFECTIVE, DATE_FALLBACK, PREAMBLE = 8000, 1200, 400, 220, 170, 2500, 4000
MOST_WINDOWS, MOST_DATES = 6, 8
ANCHORS = {
    "governing law": (
        r"govern(?:ed|ing)\s+(?:by|law)",
        r"construed\s+in\s+accordance",
        r"laws?\s+of\s+the\s+(?:State|Commonwealth|Province)",
        r"interpreted\s+and\s+enforced",
        r"applicable\s+law",
    ),
    "notice period to terminate renewal": (
        r"notice\s+of\s+non-?renewal",
        r"non-?renewal",
        r"notice.{0,60}prior\s+to\s+the\s+(?:end|expiration)",
        r"renew.{0,200}?notice",
        r"written\s+notice.{0,80}renew",
    ),
    "renewal term": (
        r"automatically\s+renew",
        r"shall\s+renew",
        r"renewal\s+term",
        r"successive\s+(?:terms|periods)",
        r"additional\s+(?:term|period)",
    ),
}
AGREEMENT_DATE = (
    r"dated\s+as\s+of",
    r"made\s+(?:and\s+entered\s+into\s+)?as\s+of",
    r"entered\s+into\s+(?:as\s+of|on)",
    r"made\s+(?:as\s+of|on)",
    r"this\s+\d{1,2}\s*(?:st|nd|rd|th|t\s*h)?\s+day\s+of",
    r"executed\s+(?:as\s+of|on)",
)
EFFECTIVE_DATE = (
    r"effective\s+Date[^.\n]{0,40}?(?:is|as\s+of|:)",
    r"effective\s+as\s+of",
    r"\"?Effective\s+Date\"?\)?\s*[:,]",
    r"effective\s+Date",
)
BETWEEN = r"(?is)(?=b)\b(?:by\s+and\s+between|between)\b(.{0,900}?)(?:\bwitnesseth\b|\brecitals\b|\n\s*\n|$)"


#: Words without which a pattern can't match: they are looked for first, which costs far less than a pattern does.
NEEDS = {
    r"govern(?:ed|ing)\s+(?:by|law)": ("govern",),
    r"construed\s+in\s+accordance": ("construed", "accordance"),
    r"laws?\s+of\s+the\s+(?:State|Commonwealth|Province)": ("law",),
    r"interpreted\s+and\s+enforced": ("interpreted", "enforced"),
    r"applicable\s+law": ("applicable", "law"),
    r"notice\s+of\s+non-?renewal": ("notice", "renewal"),
    r"non-?renewal": ("renewal",),
    r"notice.{0,60}prior\s+to\s+the\s+(?:end|expiration)": ("notice", "prior"),
    r"renew.{0,200}?notice": ("renew", "notice"),
    r"written\s+notice.{0,80}renew": ("written", "notice", "renew"),
    r"automatically\s+renew": ("automatically", "renew"),
    r"shall\s+renew": ("shall", "renew"),
    r"renewal\s+term": ("renewal", "term"),
    r"successive\s+(?:terms|periods)": ("successive",),
    r"additional\s+(?:term|period)": ("additional",),
    r"dated\s+as\s+of": ("dated",),
    r"made\s+(?:and\s+entered\s+into\s+)?as\s+of": ("made",),
    r"entered\s+into\s+(?:as\s+of|on)": ("entered", "into"),
    r"made\s+(?:as\s+of|on)": ("made",),
    r"this\s+\d{1,2}\s*(?:st|nd|rd|th|t\s*h)?\s+day\s+of": ("this", "day"),
    r"executed\s+(?:as\s+of|on)": ("executed",),
    r"effective\s+Date[^.\n]{0,40}?(?:is|as\s+of|:)": ("effective", "date"),
    r"effective\s+as\s+of": ("effective",),
    r"\"?Effective\s+Date\"?\)?\s*[:,]": ("effective", "date"),
    r"effective\s+Date": ("effective", "date"),
}


def around(text: Column, patterns: tuple[str, ...], before: int, after: int, most: int) -> Column:
    """Windows around the matches of the patterns, in the order of patterns and then of places, ``most`` at most."""
    none = F.array().cast("array<string>")

    def cut(m: Column) -> Column:
        start = F.greatest(m["start"] - before, F.lit(0))
        return F.substring(text, start + 1, m["end"] + after - start)

    def of(p: str) -> Column:
        return F.when(holds(F.lower(text), NEEDS.get(p, ())), F.transform(matches(text, f"(?id){p}", most), cut)).when(text.isNotNull(), none)

    return F.slice(F.flatten(F.array(*(of(p) for p in patterns))), 1, most)


def front(text: Column) -> Column:
    return F.left(text, F.lit(FRONT))


def agreement_date(text: Column) -> Column:
    found = around(front(text), AGREEMENT_DATE, 0, AFTER_DATE, MOST_DATES)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.left(text, F.lit(DATE_FALLBACK))))


def effective_date(text: Column) -> Column:
    """Windows at the effective date's own words, then at the agreement date's."""
    found = F.concat(around(front(text), EFFECTIVE_DATE, BEFORE_EFFECTIVE, AFTER_DATE, MOST_DATES), around(front(text), AGREEMENT_DATE, 0, AFTER_DATE, MOST_DATES))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.left(text, F.lit(DATE_FALLBACK))))


def parties(text: Column) -> Column:
    """What stands between the parties' introduction and the recitals, and the preamble."""
    said = F.filter(extract_all(front(text), BETWEEN, 1), lambda p: F.length(strip(p)) >= 30)
    return F.concat(said, F.array(F.left(text, F.lit(PREAMBLE))))


def fragments(category: str, text: Column) -> Column:
    """By a category's key; an empty array for one without a strategy."""
    if category in ANCHORS:
        return around(text, ANCHORS[category], BEFORE, AFTER, MOST_WINDOWS)
    known = {"document name": located_title, "parties": parties, "agreement date": agreement_date, "effective date": effective_date}
    return known[category](text) if category in known else F.array().cast("array<string>")


def supports(category: str) -> bool:
    return category in ANCHORS or category in ("document name", "parties", "agreement date", "effective date")
