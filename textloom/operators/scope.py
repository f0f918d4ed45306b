"""Which categories may answer on their own, decided by their measures; and the category table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.text import strip_prefix

# The measures that a category needs, and the decision which category is handled how.
MIN_RULE, MIN_BALANCED, MIN_RECALL, EXPECTED = 65.0, 70.0, 70.0, 41
MODEL = ("Parties",)
RULE = ("Document Name", "Parties (dropped from rule bucket)", "Agreement Date", "Effective Date", "Governing Law")
HYBRID = ("Notice Period to Terminate Renewal",)
HUMAN = (
    "Cap on Liability", "Uncapped Liability", "Liquidated Damages", "IP Ownership Assignment", "Joint IP Ownership", "Source Code Escrow",
    "Change of Control", "Anti-Assignment", "Non-Compete", "Exclusivity", "Most Favored Nation", "Minimum Commitment", "Expiration Date", "Renewal Term",
)


def bucket_of(name: Column) -> Column:
    """model, rule, hybrid, human or retrieval, the first that applies."""
    return F.when(name.isin(*MODEL), "model").when(name.isin(*RULE), "rule").when(name.isin(*HYBRID), "hybrid").when(name.isin(*HUMAN), "human").otherwise("retrieval")


def categories(cells: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``(category, description, format, group)`` with labels in the cells -> the category table; ``extra(category, …)`` adds columns where a category has them."""
    plain = cells.select(*(strip_prefix(F.col(c)).alias(c) for c in ("category", "description")), F.nullif(strip_prefix(F.col("format")), F.lit("")).alias("format"), strip_prefix(F.col("group")).alias("group"))
    out = plain.withColumn("bucket", bucket_of(F.col("category"))).withColumn("closes_alone", F.col("bucket") != "human")
    return out.join(F.broadcast(extra), "category", "left") if extra is not None else out


def bucket_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("closes_alone").alias("alone"))


def validate(table: DataFrame) -> DataFrame:
    """(problem, category): a wrong number of categories, and assigned names that the table lacks."""
    spark = table.sparkSession
    assigned = spark.createDataFrame([(n,) for n in sorted({*RULE, *HYBRID, *HUMAN})], "category string")
    missing = assigned.join(table, "category", "left_anti").select(F.lit("unknown name").alias("problem"), "category")
    count = table.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != EXPECTED).select(F.lit("wrong number").alias("problem"), F.col("n").cast("string").alias("category"))
    return missing.unionByName(count)


def decide(rules: DataFrame, presence: DataFrame, baselines: DataFrame) -> DataFrame:
    """``rules(category, measure)``, ``presence(category, balanced, recall)``, ``baselines(category, naive, product)`` -> (category, engine, measure, recall, naive, in_scope).

    A rule needs 65, a presence category 70 in balanced accuracy and in recall; neither may be known to do no better than its naive baseline. Baselines match by the exact name: one of another
    spelling is unknown, and what is unknown passes.
    """
    one = rules.select("category", F.lit("rule").alias("engine"), F.col("measure").cast("double").alias("measure"), F.lit(None).cast("double").alias("recall"), (F.col("measure") >= MIN_RULE).alias("good"))
    two = presence.select("category", F.lit("presence").alias("engine"), F.col("balanced").cast("double").alias("measure"), F.col("recall").cast("double").alias("recall"), ((F.col("balanced") >= MIN_BALANCED) & (F.col("recall") >= MIN_RECALL)).alias("good"))
    known = baselines.select("category", F.col("naive").cast("double").alias("naive"), F.col("product").cast("double").alias("product"))
    met = one.unionByName(two).join(F.broadcast(known), "category", "left")
    return met.select("category", "engine", "measure", "recall", "naive", (F.col("good") & F.coalesce(F.col("product") > F.col("naive"), F.lit(True))).alias("in_scope"))


def ordered(decided: DataFrame) -> DataFrame:
    """Those in scope first, each list by its measure from the highest; ties by name."""
    return decided.orderBy(F.desc("in_scope"), F.desc("measure"), "category")


def config(spark: SparkSession, path: str) -> DataFrame:
    """The category table as ``writers.categories_files`` writes it (JSON records with optional attributes), attributes that a category lacks being null."""
    return spark.read.option("multiLine", True).json(path)
