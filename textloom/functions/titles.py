"""Document titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import extract, first_of, has, let, or_null, replace, split, strip

# Control characters, lines that are never titles, words that name a kind of document.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BOILERPLATE = r"(?i)^(exhibit|ex-|execution\s+(copy|version)|confidential|page\s+\d+|redacted|filed|form\s+\d|schedule\b|annex\b|\[?\*+\]?|\d+[\d.\-]*)\b"
KIND = r"(?i)\b(agreements?|contract|licen[cs]e|lease|indenture|memorandum\s+of\s+understanding)\b"
OPENING = r"(?i)^(this|the|whereas|between)\b"
IN_BODY = r"(?id)\bthis\s+(.{0,70}?\b(?:agreement|contract|licen[cs]e))\b"


def plausible_title(text: Column) -> Column:
    """The text without control characters if it can be a title: 8 to 200 characters, no angle brackets, 60 % letters and spaces, one word of three letters; else null."""

    def checked(t: Column) -> Column:
        size, letters = F.length(t), F.length(replace(t, r"[^\p{L}\s]", ""))
        return F.when((size >= 8) & (size <= 200) & ~has(t, "[<>]") & (letters / size >= 0.6) & has(t, "[A-Za-z]{3,}"), t)

    return let(strip(replace(F.coalesce(text, F.lit("")), CONTROL, "")), checked)


def rule_title(fragments: Column) -> Column:
    return F.when(F.size(fragments) > 0, plausible_title(F.get(fragments, F.lit(0))))


def naive_title(text: Column) -> Column:
    """The first line that isn't blank."""
    lines = split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    return F.get(F.filter(F.transform(lines, strip), lambda x: x != ""), F.lit(0))


def _cut(title: Column) -> Column:
    """Up to its last word that names a kind of document."""
    return strip(F.coalesce(or_null(extract(title, r"(?is)^(.*" + KIND.removeprefix("(?i)") + ")", 1)), title))


def located_title(text: Column) -> Column:
    """Where the title stands: an array of one text.

    Pieces of the first 3000 characters, at line ends and wide gaps, are looked at in order. The first that names a kind of document in capitals is taken; else
    the best candidate (a kind first, then the share of capitals, then the order); else the document's name for itself in the body, in capitals; else the first piece.
    """
    pieces = F.filter(F.transform(split(F.left(text, F.lit(3000)), r"\n|\s{2,}"), strip), lambda p: p != "")
    letters = lambda p: replace(p, r"[^\p{L}]", "")

    def rated(p: Column, i: Column) -> Column:
        all_, capitals = F.length(letters(p)), F.length(replace(p, r"[^\p{Lu}]", ""))
        open_ = (F.length(p) >= 8) & (F.length(p) <= 130) & ~has(p, BOILERPLATE) & ~has(p, OPENING) & (all_ > 0)
        share = F.when(all_ > 0, capitals / all_).otherwise(0.0)
        return F.struct(F.when(has(p, KIND), 0).otherwise(1).alias("kind"), (-share).alias("share"), i.alias("at"), p.alias("text"), open_.alias("open"))

    def chosen(all_: Column) -> Column:
        looked = F.slice(all_, 1, 40)
        # Pieces after a loud one aren't looked at, and none is rated if there is one.
        loud = first_of(looked, lambda p: F.when(has(p, KIND) & rated(p, F.lit(0))["open"] & (rated(p, F.lit(0))["share"] < -0.7), p))
        best = F.array_min(F.filter(F.transform(looked, rated), lambda x: x["open"] & ((x["kind"] == 0) | (x["share"] < -0.85))))["text"]
        title = let(F.coalesce(loud, best), lambda t: F.when(t.isNotNull(), _cut(t)))
        body = F.upper(strip(or_null(extract(F.left(text, F.lit(4000)), IN_BODY, 1))))
        return F.array(F.coalesce(title, body, F.get(all_, F.lit(0)), F.lit("")))

    return let(pieces, chosen)
