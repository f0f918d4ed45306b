"""Confidence of single rows from the distance between score and threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Edges of the margin's bins (doubles), observations that a bin needs.
EDGES, MIN_PER_BIN = (0.0, 0.02, 0.05, 0.10, 1.0), 8


def bin_of(margin: Column) -> Column:
    """Number of the bin; the last one also takes what lies beyond."""
    out = F.lit(len(EDGES) - 2)
    for i in reversed(range(len(EDGES) - 1)):
        out = F.when((margin >= F.lit(EDGES[i])) & (margin < F.lit(EDGES[i + 1])), i).otherwise(out)
    return out


def observations(scored: DataFrame) -> DataFrame:
    """``(category, score, threshold, label)`` -> (category, bin, correct)."""
    rows = scored.where("threshold is not null")
    return rows.select("category", bin_of(F.abs(F.col("score") - F.col("threshold"))).alias("bin"), ((F.col("score") >= F.col("threshold")) == F.col("label")).alias("correct"))


def fit(observed: DataFrame) -> DataFrame:
    """(category, bins, fallback): accuracy of each bin with eight observations, and of all."""
    right = F.col("correct").cast("double")
    each = observed.groupBy("category", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.sum(right).alias("right"))
    pair = F.when(F.col("n") >= MIN_PER_BIN, F.struct("bin", "accuracy"))
    return each.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("bins"), (F.sum("right") / F.sum("n")).alias("fallback"))


def row_confidence(score: Column, threshold: Column, bins: Column, fallback: Column) -> Column:
    """Percentage; null where the category isn't calibrated."""
    return 100 * F.coalesce(bins[bin_of(F.abs(score - threshold))], F.when(threshold.isNotNull(), fallback))


def expected_error(stated: DataFrame) -> DataFrame:
    """``(stated, n, actual)`` -> one row (ece): mean distance of stated and actual accuracy by n, 0 if empty."""
    return stated.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("stated") - F.col("actual"))) / F.sum("n"), F.lit(0.0)).alias("ece"))
