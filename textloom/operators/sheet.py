"""The clause sheet: one row for each document and category in scope.

States: found, absent (backed by the measured recall), review, absent_review (seems absent; a person confirms), model_pending (the rule lost).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import dates, law, location, parties, terms, titles
from textloom.functions.text import key_of, let, plain_key, squeeze
from textloom.operators import calibration, windows

# The confidence below which a rule gives way to a model, the recall that backs an absence, the location accuracy that allows a jump, and text lengths.
MIN_CONFIDENCE, RECALL_FOR_ABSENCE, LOCATION_TO_JUMP, RULE_TEXT, PRESENCE_TEXT = 50.0, 60.0, 50.0, 300, 400
RULES = {
    "document name": titles.rule_title,
    "governing law": law.rule_law,
    "agreement date": dates.rule_date,
    "effective date": dates.rule_date,
    "notice period to terminate renewal": terms.rule_notice,
    "renewal term": terms.rule_renewal,
    "parties": parties.parties_in,
}
#: How the rules' categories are handled, and their accuracy end to end where none is measured anew. Fixed values.
BUCKETS = {"Document Name": "rule", "Governing Law": "rule", "Agreement Date": "rule", "Effective Date": "rule", "Notice Period To Terminate Renewal": "hybrid", "Renewal Term": "human", "Parties": "model"}
MEASURED = [("Governing Law", "rule", 91.0), ("Agreement Date", "rule", 73.6), ("Document Name", "rule", 71.7), ("Effective Date", "rule", 68.0), ("Notice Period to Terminate Renewal", "hybrid", 42.9), ("Renewal Term", "human", 48.8), ("Parties", "model", 4.6)]
COLUMNS = "name", "category", "bucket", "state", "value", "text", "confidence", "confidence_kind", "start", "engine", "clause_accuracy"
ORDER = {"found": 0, "review": 1, "absent_review": 2, "absent": 3, "model_pending": 4}


def presence_state(score: Column, threshold: Column, recall: Column) -> Column:
    """review without a threshold or measures; found from the threshold on; absent where the recall backs it, else absent_review."""
    return F.when(threshold.isNull() | recall.isNull(), "review").when(score >= threshold, "found").when(recall >= RECALL_FOR_ABSENCE, "absent").otherwise("absent_review")


def demote(state: Column, bucket: Column) -> Column:
    """Categories that a person must see never close on their own."""
    return F.when((bucket == "human") & (state == "found"), "review").when((bucket == "human") & (state == "absent"), "absent_review").otherwise(state)


def rule_rows(docs: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``docs(name, text)`` -> rule rows for ``rules``: (category, bucket, measured accuracy), all in one pass over the texts."""

    def row(category: str, bucket: str, measure: float) -> Column:
        key = category.lower()
        base = [F.lit(category).alias("category"), F.lit(bucket).alias("bucket")]
        said = lambda state, value, text: F.struct(*base, state.alias("state"), value.cast("string").alias("value"), text.cast("string").alias("text"), F.lit(float(measure)).alias("confidence"))
        none = F.lit(None)
        if measure < MIN_CONFIDENCE:
            return said(F.lit("model_pending"), none, none)
        human = bucket == "human"

        def found(f: Column) -> Column:
            return let(RULES[key](f), lambda v: F.when(F.coalesce(v, F.lit("")) == "", said(F.lit("review" if human else "absent"), none, none)).otherwise(said(F.lit("review" if human else "found"), v, F.get(f, F.lit(0)))))

        return let(location.fragments(key, F.col("text")), found)

    rows = docs.select("name", F.explode(F.array(*(row(*r) for r in rules))).alias("r"))
    # The fragment is cut here, so that it isn't where nobody asks for it.
    kept, shown = ("category", "bucket", "state", "value"), F.left(squeeze(F.col("r.text")), F.lit(RULE_TEXT)).alias("text")
    return rows.select("name", *(F.col(f"r.{c}") for c in kept), shown, F.col("r.confidence"), F.lit("clause").alias("confidence_kind"), F.lit(None).cast("int").alias("start"), F.lit("rule").alias("engine"), F.col("r.confidence").alias("clause_accuracy"))


def presence_rows(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``docs(name, text)`` by ``model(category, bucket, cues, threshold, recall, balanced, located_pct, bins, fallback)``."""
    best = windows.by_model(docs, model).withColumnRenamed("_best", "_b")
    state = presence_state(F.col("_b.score"), F.col("threshold"), F.col("recall"))
    own = calibration.row_confidence(F.col("_b.score"), F.col("threshold"), F.col("bins"), F.col("fallback"))
    jump = F.when((F.col("_state") == "found") & (F.coalesce(F.col("located_pct"), F.lit(0.0)) >= LOCATION_TO_JUMP), F.col("_b.start"))
    judged = best.withColumn("_state", state).withColumn("start", jump).withColumn("state", demote(F.col("_state"), F.col("bucket")))
    sure = F.when(F.col("_state") != "review", F.coalesce(own, F.col("balanced")))
    return judged.select(
        "name",
        "category",
        "bucket",
        "state",
        F.when(F.contains("state", F.lit("found")), "present").alias("value"),
        F.when(F.col("start").isNotNull(), squeeze(F.substring(F.col("text"), F.col("start") + 1, F.lit(PRESENCE_TEXT)))).alias("text"),
        sure.alias("confidence"),
        F.when(sure.isNotNull(), "row").alias("confidence_kind"),
        "start",
        F.lit("presence").alias("engine"),
        F.col("balanced").alias("clause_accuracy"),
    )


def sheet(docs: DataFrame, rules: list[tuple[str, str, float]], model: DataFrame) -> DataFrame:
    """All rows of all documents."""
    return rule_rows(docs, rules).select(*COLUMNS).unionByName(presence_rows(docs, model).select(*COLUMNS))


def footer(rows: DataFrame) -> DataFrame:
    """By document: rows that close, rows to review, rows that wait for a model, all rows."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return rows.groupBy("name").agg(n("found", "absent").alias("closed"), n("review", "absent_review").alias("to_review"), n("model_pending").alias("pending"), F.count(F.lit(1)).alias("rows"))


def display_order(rows: DataFrame) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    return rows.orderBy("name", rank[F.col("state")], "category")


def scoped(docs: DataFrame, rules: list[tuple[str, str, float]], model: DataFrame, scope: DataFrame) -> DataFrame:
    """``scope_filter`` of the sheet. Categories are matched before, so that texts aren't read for one that is out of scope."""
    keys = {r[0] for r in scope.where("in_scope").select(key_of(F.col("category"))).distinct().collect()}
    ours, held = [r for r in rules if plain_key(r[0]) in keys], model.where(key_of(F.col("category")).isin(*keys))
    if held.isEmpty():
        return rule_rows(docs, ours).select(*COLUMNS) if ours else sheet(docs, rules, model).limit(0)
    return sheet(docs, ours, held) if ours else presence_rows(docs, held).select(*COLUMNS)


def scope_filter(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows whose category is in scope, matched by key."""
    keys = scope.where("in_scope").select(key_of(F.col("category")).alias("_key")).distinct()
    return rows.withColumn("_key", key_of(F.col("category"))).join(F.broadcast(keys), "_key", "left_semi").drop("_key")
