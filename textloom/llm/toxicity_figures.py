"""How well held-out labels are ranked by the dictionaries of ``toxicity``, and by dictionaries that zstandard trains on the two kinds of text.

    python -m textloom.llm.toxicity_figures /root/testdata/sf0.1
"""

from __future__ import annotations

import random
import sys

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import toxicity


def area(scores: np.ndarray, toxic: np.ndarray) -> float:
    """Share of pairs of a toxic and an ordinary row in which the toxic one scores higher; ties count half."""
    values, at, times = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[at]
    p = toxic.sum()
    return float((rank[toxic == 1].sum() - p * (p + 1) / 2) / (p * (len(toxic) - p)))


def summary(scores: np.ndarray, toxic: np.ndarray) -> dict[str, float]:
    above = scores >= 0.5
    return {"auc": round(area(scores, toxic), 3), "recall": round(float(above[toxic == 1].mean()), 3), "false_alarms": round(float(above[toxic == 0].mean()), 4), "held_out": len(toxic)}


def trained(texts: list[str], size: int, seed: int = 1, most: int = 100_000) -> bytes:
    """What zstandard's own training makes of a sample of the texts' windows."""
    cut = [w for t in texts for w in toxicity.windows(t)]
    random.Random(seed).shuffle(cut)
    return zstandard.train_dictionary(size, cut[:most]).as_bytes()


def generic_model(rows: list[tuple[str, int]], size: int) -> toxicity.Model:
    """A model with two trained dictionaries: 60 % of either kind for these, the rest for weights and cut."""
    kinds = [[t for t, y in rows if y == kind] for kind in (1, 0)]
    cuts = [len(k) * 6 // 10 for k in kinds]
    contents = [trained(k[:c], size) for k, c in zip(kinds, cuts, strict=True)]
    pair = [toxicity.compressor(c) for c in contents]
    rest = [(t, y) for k, c, y in zip(kinds, cuts, (1.0, 0.0), strict=True) for t in k[c:]]
    x = np.array([toxicity.figures(t, *pair) for t, _ in rest])
    return toxicity.Model(*contents, *toxicity.calibrate(x, np.array([y for _, y in rest])))


def measure(docs: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """Figures by kind of dictionary. All labelled texts come to the driver: this is a measurement on test tables, no operator."""
    both = docs.join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = both.select("text", "toxic", toxicity.held_out("doc_id").alias("held")).collect()
    held = [(r["text"], r["toxic"]) for r in rows if r["held"]]
    fit = [(r["text"], r["toxic"]) for r in rows if not r["held"]]
    contrast = toxicity.fit_labelled(docs, labels)
    out = {}
    for name, model in (("contrast", contrast), ("trained", generic_model(fit, len(contrast.toxic)))):
        pair = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
        out[name] = summary(model.score(np.array([toxicity.figures(t, *pair) for t, _ in held])), np.array([y for _, y in held])) | {"dictionary_bytes": len(model.toxic), "labels": len(fit)}
    return out


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    read = lambda t: spark.read.parquet(f"{sys.argv[1]}/{t}.parquet")
    for kind, found in measure(read("documents"), read("labels")).items():
        print(kind, found)
