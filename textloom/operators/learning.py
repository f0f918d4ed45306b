"""Learning which words tell documents with a clause from documents without, and from which score on it counts as found.

Splits are by document, never by question: one text is never on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import WINDOW, needle, squeeze, word_set
from textloom.operators.ranking import with_rank

# Shares of the split, words kept, positives that learning needs, rows of either kind that calibration needs, and the steps of the threshold.
TRAIN, VALIDATE, TOP_TERMS, MIN_TRAIN, MIN_EACH, STEPS = 0.6, 0.8, 40, 5, 5, 40


def split_by_name(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ``(name)`` -> ``(name, part)``: by order of names 60 % train, 20 % val, the rest test."""
    ranked, n = with_rank(names.select(name), [name])
    part = F.when(F.col("rank") < int(n * TRAIN), "train").when(F.col("rank") < int(n * VALIDATE), "val").otherwise("test")
    return ranked.select(name, part.alias("part"))


def document_frequency(train: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``train(name, text)`` and ``labels(name, category, label)`` -> (category, term, with_clause, without_clause).

    Labels join whole documents, before these become words: a document moves once, its words only as counts.
    """
    by_name = labels.groupBy("name").agg(F.collect_list(F.struct("category", "label")).alias("labels"))
    words = train.select("name", text_col).join(by_name, "name").select("labels", F.explode(word_set(F.col(text_col))).alias("term"))
    each = words.select("term", F.explode("labels").alias("l")).select("term", "l.category", F.col("l.label").cast("int").alias("hit"))
    return each.groupBy("category", "term").agg(F.sum("hit").cast("bigint").alias("with_clause"), F.sum(1 - F.col("hit")).cast("bigint").alias("without_clause"))


def log_odds(with_: Column, without: Column, n_with: Column, n_without: Column) -> Column:
    return F.log(((with_ + 0.5) / (n_with + 1)) / ((without + 0.5) / (n_without + 1)))


def cue_terms(frequency: DataFrame, labels: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(category, term, log_odds, place): at most ``top`` terms with a positive value, ties by term; none for categories with fewer than five positives.

    Values are rounded to 12 digits before they are ranked, so that the last bit of a logarithm decides nothing.
    """
    hit = F.col("label").cast("int")
    totals = labels.groupBy("category").agg(F.sum(hit).alias("n_with"), F.sum(1 - hit).alias("n_without")).where(F.col("n_with") >= MIN_TRAIN)
    scored = frequency.join(F.broadcast(totals), "category").withColumn("log_odds", F.round(log_odds(F.col("with_clause"), F.col("without_clause"), F.col("n_with"), F.col("n_without")), 12))
    order = Window.partitionBy("category").orderBy(F.desc("log_odds"), "term")
    return scored.where("log_odds > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("category", "term", "log_odds", "place")


def cue_table(terms: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, cues): an empty array for categories that learned nothing."""
    lists = terms.groupBy("category").agg(F.sort_array(F.collect_list("term")).alias("cues"))
    return categories.select("category").distinct().join(lists, "category", "left").select("category", F.coalesce("cues", F.array().cast("array<string>")).alias("cues"))


def sweep(scored: DataFrame) -> DataFrame:
    """``(category, score, label)`` -> (category, step, true_pos, true_neg, n_pos, n_neg, balanced) at each of 40 thresholds step/40."""
    hit, above = F.col("label"), F.col("score") >= F.col("step") / F.lit(float(STEPS))
    steps = scored.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    counts = steps.groupBy("category", "step").agg(F.count_if(hit & above).alias("true_pos"), F.count_if(~hit & ~above).alias("true_neg"), F.count_if(hit).alias("n_pos"), F.count_if(~hit).alias("n_neg"))
    return counts.withColumn("balanced", (F.col("true_pos") / F.nullif("n_pos", F.lit(0)) + F.col("true_neg") / F.nullif("n_neg", F.lit(0))) / 2)


def thresholds(swept: DataFrame) -> DataFrame:
    """(category, threshold): of equals the lowest, 0.5 where none is better than 0, null with fewer than five rows of either kind."""
    best = swept.groupBy("category").agg(F.min_by("step", F.struct((-F.col("balanced")).alias("b"), "step")).alias("step"), F.max("balanced").alias("top"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    enough = (F.col("n_pos") >= MIN_EACH) & (F.col("n_neg") >= MIN_EACH)
    return best.select("category", F.when(enough, F.when(F.col("top") > 0, F.col("step") / F.lit(float(STEPS))).otherwise(0.5)).alias("threshold"))


def located(text: Column, start: Column, gold: Column) -> Column:
    """Whether the first 60 characters of the gold passage stand in the window; null without either."""
    chunk, wanted = squeeze(F.substring(text, start + 1, WINDOW)), needle(gold)
    return F.when(start.isNotNull() & gold.isNotNull(), (wanted != "") & F.contains(chunk, wanted))


def metrics(judged: DataFrame) -> DataFrame:
    """``(category, score, threshold, label, located)`` -> one row a category: counts, floor, accuracy, balanced, recall, specificity, located_pct (percentages).

    Categories without a threshold or with one kind of rows only are left out. ``located`` counts in true positives only.
    """
    hit, said = F.col("label"), F.col("score") >= F.col("threshold")
    counts = judged.where("threshold is not null").groupBy("category").agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & ~said).alias("tn"),
        F.count_if(hit).alias("positives"),
        F.count_if(~hit).alias("negatives"),
        F.avg(F.when(hit & said, F.col("located").cast("double"))).alias("hit_rate"),
    )
    n, recall, specificity = F.col("positives") + F.col("negatives"), F.col("tp") / F.col("positives"), F.col("tn") / F.col("negatives")
    return counts.where("positives > 0 and negatives > 0").select(
        "category",
        n.alias("n"),
        "positives",
        (100 * F.greatest("positives", "negatives") / n).alias("floor"),
        (100 * (F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        (100 * (recall + specificity) / 2).alias("balanced"),
        (100 * recall).alias("recall"),
        (100 * specificity).alias("specificity"),
        (100 * F.col("hit_rate")).alias("located_pct"),
    )


def summary(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: mean balanced accuracy, categories above 55, and the categories that couldn't be calibrated."""
    left = categories.select("category").distinct().join(rows.select("category"), "category", "left_anti")
    return rows.agg(F.avg("balanced").alias("mean_balanced"), F.count_if(F.col("balanced") > 55).alias("above_55"), F.count(F.lit(1)).alias("measured")).crossJoin(left.agg(F.array_join(F.sort_array(F.collect_list("category")), ", ").alias("not_measured")))


def ordered(rows: DataFrame) -> DataFrame:
    """Metric rows by balanced accuracy from the highest; ties by name."""
    return rows.orderBy(F.desc("balanced"), "category")
