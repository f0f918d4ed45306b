"""License scans by an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words as long as the template allows (``stretch`` times its number of distinct
words). It matches if it holds at least the threshold of the template's distinct words.

Filters, none of which loses a match. Tokens are ordered by their frequency in all documents, rare ones first. With o words
needed of t, each matching block holds one of the first t - o + 1 (the prefix). So only documents with a prefix word go on (prefix
filter), if they have o words at all (length filter), and only blocks around such a word are compared (positional filter).

Beside the templates there are phrases: places where their words stand consecutively. DataFrame functions only; two passes over
the texts, and no text moves: templates are a fixed list that travels with the plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import let
from textloom.llm._common import free_name

#: Words are letters A-Z (lower-cased), digits and all code points from 128 on.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    stretch: float = 1.5

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(self.text.split()))

    @property
    def needed(self) -> int:
        return max(1, ceil(self.threshold * len(self.words) - 1e-9))

    @property
    def width(self) -> int:
        return max(len(self.text.split()), ceil(self.stretch * len(self.words)))


#: The customary wording of license texts, notices and grants. Short notices must be met whole.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", 0.8, 3.0),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", 0.8, 3.0),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", 0.8, 3.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "released under the mit license", 1.0, 1.0),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("apache-2", "licensed under the apache license version 2 0", 1.0, 1.0),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", 0.9, 1.2),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "licensed under the gnu lesser general public license", 1.0, 1.0),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0, 1.2),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", 0.95),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.95, 1.2),
)


def spaced(text: Column) -> Column:
    """The words of a text, each with one space before, and a space at the end; a single space without words.

    ``lower`` also changes letters beyond A-Z, always within words; the one sign that it would turn into a letter a-z (the Kelvin sign) is replaced before.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    plain = F.trim(F.regexp_replace(low, NO_WORD, " "))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts; ``words`` as ``spaced`` gives them."""
    n = len(phrase.split())
    parts = F.split(words, f" {phrase}(?= )", -1)
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _spaces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    found = F.aggregate(before, start, step, lambda acc: acc["out"])
    return F.when(F.contains(words, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))


def token_order(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """How often each word of the templates occurs in all documents; the driver gets one row a template word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(F.explode(F.split(spaced(F.col(text_col)), " ")).alias("word"))
    counts = dict(words.where(F.col("word").isin(vocabulary)).groupBy("word").count().collect())
    return {w: counts.get(w, 0) for w in vocabulary}


def prefix_of(template: Template, frequency: dict[str, int]) -> list[str]:
    ranked = sorted(template.words, key=lambda w: (frequency[w], w))
    return ranked[: len(ranked) - template.needed + 1]


def _blocks(words: Column, template: Template, prefix: list[str], hits: Column) -> Column:
    """Blocks around prefix words as (start, held): the first word and how many words of the template each holds."""
    goal, w = F.lit(template.words), template.width
    at = F.filter(hits, lambda h: h["word"].isin(prefix))

    def around(h: Column) -> Column:
        first = F.greatest(h["at"] - (w - 1), F.lit(0))
        return F.transform(F.sequence(first, h["at"]), lambda s: F.struct(s.alias("start"), F.size(F.array_intersect(F.slice(words, s + 1, F.lit(w)), goal)).alias("held")))

    return F.flatten(F.transform(at, around))


def _spans(blocks: Column, template: Template, n_words: Column) -> Column:
    """Where blocks reach the template: word numbers (from, to), ends exclusive, overlapping blocks as one."""
    w = template.width
    starts = F.array_sort(F.array_distinct(F.transform(F.filter(blocks, lambda x: x["held"] >= template.needed), lambda x: x["start"])))
    end = lambda s: F.least(s + w, n_words.cast("int"))

    def merge(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), end(s).alias("to"))))
        return F.when(F.coalesce(s <= last["to"], F.lit(False)), longer).otherwise(F.concat(out, F.array(F.struct(s.alias("from"), end(s).alias("to")))))

    return F.aggregate(starts, F.array().cast("array<struct<from: int, to: int>>"), merge)


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """``docs`` with n_words, places (array of word number and label), matches (array of label, containment and spans of each template reached) and best appended.

    ``spans``: word numbers (from, to) of all blocks that reach the template, ends exclusive, overlapping ones merged. ``best``: the highest containment of any template compared, 1 with a phrase,
    else 0. Null and empty texts have no words; long texts are read whole; words equally frequent are ordered by themselves; rows are
    independent, so repeated rows repeat. Appended names that ``docs`` has already get an underscore. An empty table gives an empty result.
    """
    frequency = token_order(docs, text_col, templates)
    prefixes = [prefix_of(t, frequency) for t in templates]
    names = {n: free_name(docs, n) for n in ("n_words", "places", "matches", "best", "spaced", "words", "hits")}
    some = sorted({w for p in prefixes for w in p})
    text = F.col(names["spaced"])
    cased = docs.withColumn(names["spaced"], spaced(F.col(text_col)))
    each = [_labelled(phrase_places(text, p), label) for p, label in phrases]
    counted = cased.withColumn(names["n_words"], (_spaces(text) - 1).cast("bigint")).withColumn(names["places"], F.array_sort(F.concat(*each)))
    # Prefix filter on whole documents, then the positions of prefix words in those that are left.
    any_prefix = F.lit(False)
    for w in some:
        any_prefix = any_prefix | F.contains(text, F.lit(f" {w} "))
    least = min((t.needed for t in templates), default=1)
    split = F.when(any_prefix & (F.col(names["n_words"]) >= least), F.split(F.trim(text), " "))
    placed = F.filter(F.transform(names["words"], lambda w, i: F.when(w.isin(some), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    listed = counted.withColumn(names["words"], split).withColumn(names["hits"], placed)
    def rated(t: Template, prefix: list[str]) -> Column:
        def one(blocks: Column) -> Column:
            held = F.coalesce(F.array_max(F.transform(blocks, lambda x: x["held"])), F.lit(0))
            return F.struct(F.lit(t.label).alias("label"), (held / F.lit(float(len(t.words)))).alias("containment"), F.lit(t.needed / len(t.words)).alias("least"), F.when(held >= t.needed, _spans(blocks, t, F.col(names["n_words"]))).alias("spans"))

        return let(_blocks(F.col(names["words"]), t, prefix, F.col(names["hits"])), one)

    none = F.array().cast("array<struct<label: string, containment: double, least: double, spans: array<struct<from: int, to: int>>>>")
    every = F.array(*(rated(t, p) for t, p in zip(templates, prefixes, strict=True))) if templates else none
    found = listed.withColumn(names["matches"], F.when(F.size(names["hits"]) > 0, every).otherwise(none))
    best = F.greatest(F.coalesce(F.array_max(F.transform(names["matches"], lambda m: m["containment"])), F.lit(0.0)), F.when(F.size(names["places"]) > 0, 1.0).otherwise(0.0))
    reached = F.transform(F.filter(names["matches"], lambda m: m["containment"] >= m["least"] - 1e-9), lambda m: F.struct(m["label"].alias("label"), m["containment"].alias("containment"), m["spans"].alias("spans")))
    return found.withColumn(names["best"], best).withColumn(names["matches"], reached).select(*docs.columns, *(names[n] for n in ("n_words", "places", "matches", "best")))
