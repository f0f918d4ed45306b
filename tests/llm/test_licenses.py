import re

from pyspark.sql import functions as F

from textloom.llm import licenses

FULL = licenses.TEMPLATES[0].text
TEXTS = [
    None, "", "...", "Under the MIT license, under the mit LICENSE.", "cc by nc cc by nc", "K under the mit license", "xunder the mit license", "Apache License, Version 2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs, to deal in the Software without restriction",
    "words " * 300 + FULL.upper() + " words" * 300, "hereby " * 50, "This work is licensed under the GNU General Public License, version 3.", "dés mots é under\x00the\x7fmit:license",
    " ".join(FULL.split()[::2]), "Released under the MIT License", "İ under the mit license ſ", "under the mit license " * 400, FULL + " and then other words " * 60 + licenses.TEMPLATES[3].text,
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("best", F.lit(1)).withColumn("WORDS", F.lit(2))
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "n_words", "places", "matches", "best_"]
    for r in out.collect():
        w = words(TEXTS[r["doc_id"]])
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r["n_words"] == len(w)
        assert [tuple(p) for p in r["places"]] == places
        reached = []
        for t in licenses.TEMPLATES:
            most = max((len(set(w[i : i + t.width]) & set(t.words)) for i in range(len(w))), default=0)
            if most >= t.needed:
                covered = {j for i in range(len(w)) if len(set(w[i : i + t.width]) & set(t.words)) >= t.needed for j in range(i, min(i + t.width, len(w)))}
                reached.append((t.label, most / len(t.words), covered))
        got = [(m["label"], m["containment"], {j for s in m["spans"] for j in range(s["from"], s["to"])}) for m in r["matches"]]
        assert [g[:2] for g in got] == [e[:2] for e in reached], TEXTS[r["doc_id"]]
        # blocks that reach a template hold a prefix word, so no place is missing
        assert [g[2] for g in got] == [e[2] for e in reached]
        assert all(a["to"] < b["from"] for m in r["matches"] for a, b in zip(m["spans"], m["spans"][1:], strict=False))


def test_prefix_is_rarest_and_just_long_enough():
    t = licenses.Template("x", "a b c d e f g h i j", 0.8)
    frequency = {w: 100 - i for i, w in enumerate(t.words)}
    assert licenses.prefix_of(t, frequency) == ["j", "i", "h"]


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
