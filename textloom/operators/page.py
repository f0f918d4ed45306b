"""What a page about single documents shows: highlighted ranges, depth, and the choice of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import dates, location
from textloom.functions.text import key_of, matches, squeeze
from textloom.operators import windows

# Characters of a text that a page carries, and the dates that it highlights.
MAX_TEXT, PASSAGE = 60_000, 340
ANY_DATE = (
    r"(?i)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}"
    r"|\d{1,2}/\d{1,2}/\d{2,4}"
    r"|\d{1,2}\s*(?:st|nd|rd|th|t\s*h)?\s+day\s+of\s+[A-Za-z]+,?\s*\d{4})"
)


def value_range(category: str, text: Column, value: Column) -> Column:
    """(start, end) of the passage that a value comes from; null if it can't be told.

    Dates are found again in the category's fragments; other values by their letters, whole or up to the first semicolon.
    """
    if "date" in category.lower():

        def in_fragment(f: Column) -> Column:
            at = F.position(F.left(f, F.lit(150)), text) - 1
            hit = F.get(F.filter(matches(f, ANY_DATE), lambda m: dates.extract_date(m["found"]) == value), F.lit(0))
            return F.when((at >= 0) & hit.isNotNull(), F.struct((at + hit["start"]).alias("start"), (at + hit["end"]).alias("end")))

        found = F.filter(F.transform(location.fragments(category.lower(), text), in_fragment), lambda r: r.isNotNull())
        return F.when(F.coalesce(value, F.lit("")) != "", F.get(found, F.lit(0)))

    def place(v: Column) -> Column:
        at = F.position(F.lower(v), F.lower(text)) - 1
        return F.when((v != "") & (at >= 0), F.struct(at.alias("start"), (at + F.length(v)).alias("end")))

    return F.coalesce(place(value), place(F.trim(F.substring_index(value, ";", 1))))


def depth(start: Column, text: Column) -> Column:
    """Where a passage begins, in whole percent of the text, halves to the even one."""
    return F.bround(100.0 * start / F.length(text)).cast("int")


def ranges(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Found rule rows of a sheet with range and depth; ``docs(name, text)``, ``rows(name, category, value, …)``."""
    joined = rows.where("engine = 'rule' and value is not null").drop("text").join(docs.select("name", "text"), "name")
    chosen = F.lit(None).cast("struct<start: int, end: int>")
    for category in ("Document Name", "Governing Law", "Agreement Date", "Effective Date", "Renewal Term", "Parties"):
        chosen = F.when(F.col("category") == category, value_range(category, F.col("text"), F.col("value"))).otherwise(chosen)
    return joined.withColumn("range", chosen).withColumn("depth", depth(F.col("range.start"), F.col("text"))).drop("text")


def pages(docs: DataFrame, names: list[str]) -> DataFrame:
    """Texts of the chosen documents, as much of them as a page carries, with their whole length."""
    return docs.where(F.col("name").isin(names)).select("name", F.left("text", F.lit(MAX_TEXT)).alias("text"), F.length("text").alias("length"))


def page_rows(docs: DataFrame, rows: DataFrame, model: DataFrame, shown: DataFrame) -> DataFrame:
    """A sheet's rows with what the page adds: range (rules), passage (presence, where found) and depth, and the categories' figures from ``shown(category, pct, naive)``.

    A rule row carries its category's figure as confidence, as rules have no measure of single rows; a presence row its own.
    """
    spans = ranges(docs, rows).select("name", "category", "range", F.col("depth").alias("rule_depth"))
    best = windows.score(docs.select("name", "text"), model.select("category", "cues")).where("start is not null")
    passages = best.select("name", "category", squeeze(F.substring(F.col("text"), F.col("start") + 1, F.lit(PASSAGE))).alias("passage"), depth(F.col("start"), F.col("text")).alias("presence_depth"))
    figures = shown.select(key_of(F.col("category")).alias("_key"), F.col("pct").alias("tested"), F.col("naive"))
    joined = rows.join(spans, ["name", "category"], "left").join(passages, ["name", "category"], "left").withColumn("_key", key_of(F.col("category"))).join(F.broadcast(figures), "_key", "left")
    rule, found = F.col("engine") == "rule", F.col("state") == "found"
    return joined.select(
        "name",
        "category",
        "engine",
        "state",
        "value",
        F.when(rule, F.col("tested")).otherwise(F.col("confidence")).alias("confidence"),
        "confidence_kind",
        F.col("tested").alias("clause_accuracy"),
        "naive",
        "range",
        F.when(~rule & found, F.col("passage")).alias("passage"),
        F.when(rule, F.col("rule_depth")).when(found, F.col("presence_depth")).alias("depth"),
    )


def page_data(docs: DataFrame, names: list[str], rows: DataFrame) -> list[dict]:
    """The chosen documents, in their order, each with its text, length and rows: what a page's script reads. The driver holds these documents."""
    texts = {r["name"]: r for r in pages(docs, names).collect()}
    by_name: dict[str, list[dict]] = {}
    for r in rows.where(F.col("name").isin(names)).orderBy("name", "category").collect():
        row = r.asDict(recursive=True)
        row["range"] = [row["range"]["start"], row["range"]["end"]] if row["range"] else None
        by_name.setdefault(row.pop("name"), []).append(row)
    return [{"name": n, "text": texts[n]["text"], "length": texts[n]["length"], "rows": by_name.get(n, [])} for n in names]


def choose(docs: DataFrame, wanted: list[str], add: list[str] = (), remove: list[str] = ()) -> list[str]:
    """Names of the documents wanted, with those added and without those removed; LookupError for one that isn't there or nothing left."""
    chosen = [resolve(docs, w) for w in wanted]
    for w in add:
        if (name := resolve(docs, w)) not in chosen:
            chosen.append(name)
    for w in remove:
        if (name := resolve(docs, w)) not in chosen:
            raise LookupError(f"not in the list: {name}")
        chosen.remove(name)
    if not chosen:
        raise LookupError("the page would have no documents")
    return chosen


def resolve(docs: DataFrame, wanted: str) -> str:
    """A document's name by its number in the order of names, or by a part of it that no other has; else LookupError."""
    if wanted.isdigit():
        got = docs.select("name").orderBy("name").limit(int(wanted) + 1).tail(1)
        if not got or docs.select("name").limit(int(wanted) + 1).count() <= int(wanted):
            raise LookupError(f"no document number {wanted}")
        return got[0]["name"]
    found = [r["name"] for r in docs.where(F.contains(F.lower("name"), F.lit(wanted.lower()))).select("name").orderBy("name").limit(7).collect()]
    if len(found) != 1:
        raise LookupError(f"{wanted!r} matches " + ("no document" if not found else ", ".join(found)))
    return found[0]
