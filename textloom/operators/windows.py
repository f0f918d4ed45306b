"""Scoring of overlapping text windows by the share of cue words they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import STOP_WORDS, STRIDE, WINDOW, WORD, extract_all, let, window_starts, word_set


def windows(text: Column) -> Column:
    """Array of (start, words): each window's distinct words."""
    return F.transform(window_starts(text), lambda s: F.struct(s.alias("start"), word_set(F.substring(text, s + 1, WINDOW)).alias("words")))


def best_window(windows_: Column, cues: Column) -> Column:
    """(score, start) of the window with the largest share of the cues; of equals the first. Score 0 and no start without cues or hits."""
    wanted = F.array_distinct(cues)
    hits = F.transform(windows_, lambda w: F.struct(F.size(F.array_intersect(w["words"], wanted)).alias("n"), (-w["start"]).alias("back")))
    top = F.array_max(hits)
    some = F.coalesce((F.size(wanted) > 0) & (top["n"] > 0), F.lit(False))
    return F.struct(F.when(some, top["n"] / F.size(wanted)).otherwise(0.0).alias("score"), F.when(some, -top["back"]).alias("start"))


def best(text: Column, cues: Column) -> Column:
    """``best_window`` of a text for each of the cue lists, an array of (score, start).

    Windows are put together from pieces of a stride each, so that none is looked for from the text's start, and read once for all lists. The
    words of a window are read only if it holds a cue, wherever in a word it may stand.
    """
    wanted = F.transform(cues, lambda c: F.array_distinct(c))
    some = F.array_except(F.array_distinct(F.flatten(F.filter(cues, lambda c: c.isNotNull()))), F.lit(list(STOP_WORDS)))

    def read(x: Column) -> Column:
        lows = F.transform(x["pieces"], lambda piece, i: F.lower(F.concat(piece, F.coalesce(F.get(x["pieces"], i + 1), F.lit("")))))

        def one(low: Column, i: Column) -> Column:
            words = F.when(F.exists(x["held"], lambda c: F.contains(low, c)), F.array_intersect(extract_all(low, WORD, 0), x["held"])).otherwise(F.array().cast("array<string>"))
            return F.struct((i * STRIDE).alias("start"), words.alias("words"))

        return F.filter(F.transform(lows, one), lambda w: F.size(w["words"]) > 0)

    held = let(F.lower(text), lambda low: F.filter(some, lambda c: F.contains(low, c)))
    found = let(F.struct(held.alias("held"), extract_all(text, rf"(?s).{{1,{STRIDE}}}", 0).alias("pieces")), read)
    return let(F.struct(found.alias("found"), wanted.alias("wanted")), lambda x: F.transform(x["wanted"], lambda c: best_window(x["found"], c)))


def score(docs: DataFrame, cues: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` by ``cues(category, cues)``: with category, score and start.

    Words are taken once a document, before the categories are added. The cue table is the model, one row a category; it is broadcast as one row.
    """
    return by_model(docs, cues, text_col).select(*docs.columns, "category", F.col("_best.score").alias("score"), F.col("_best.start").alias("start"))


def by_model(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` by ``model(category, cues, …)``, with _best: (score, start)."""
    rows = F.struct(*(F.col(f"`{c}`") for c in model.columns))
    whole = model.agg(F.collect_list(rows).alias("_model"))
    read = docs.crossJoin(F.broadcast(whole)).withColumn("_all", best(F.col(text_col), F.transform("_model", lambda m: m["cues"])))
    # The model's rows are exploded, not what was read: Spark asks first whether an exploded array is empty.
    each = read.select(*docs.columns, "_all", F.posexplode("_model").alias("_i", "_m"))
    return each.select(*docs.columns, *(F.col("_m")[c].alias(c) for c in model.columns), F.get("_all", F.col("_i")).alias("_best"))
