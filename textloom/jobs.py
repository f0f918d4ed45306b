"""Training and measuring jobs over a corpus and its annotations. Each returns its tables and writes its file, if it has one."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import calibration, evaluation, learning, measure, page, scope, sheet, windows
from textloom.operators.ranking import kept
from textloom.sources import readers, writers

TEMPLATE = Path(__file__).with_name("page.html")


class Study:
    """A corpus, its annotations and a learned model, read when they are asked for."""

    def __init__(self, spark: SparkSession, corpus: str | None = None, annotations: str | None = None, model: str = "model.json", fitted: str = "calibration.json", baselines: str | None = None):
        self.spark, self.corpus, self.csv, self.model_path, self.fitted, self.baselines_path = spark, corpus, annotations, model, fitted, baselines

    @property
    def docs(self) -> DataFrame:
        return readers.corpus(self.spark, self.corpus)

    def annotations(self, **how) -> DataFrame:
        return readers.annotations(readers.csv_table(self.spark, self.csv), **how)

    @property
    def parts(self) -> DataFrame:
        """(name, part): one split for all jobs, over the corpus."""
        return learning.split_by_name(self.docs.select("name").distinct())

    def held_out(self) -> DataFrame:
        return self.docs.join(self.parts.where("part = 'test'").select("name"), "name", "left_semi")

    def labels(self) -> DataFrame:
        """(name, category, label) of the presence categories, for documents of the corpus."""
        long = self.annotations(training=True)
        known = evaluation.presence_categories(long, blank=True)
        return readers.labels(long).join(known, "category", "left_semi").join(self.docs.select("name"), "name", "left_semi")

    def gold(self) -> DataFrame:
        """(name, category, gold): the first marked passage."""
        return self.annotations(training=True).select("name", "category", F.get("spans", F.lit(0)).alias("gold"))

    def model(self) -> DataFrame:
        return readers.model(self.spark, self.model_path, self.fitted).withColumn("bucket", scope.bucket_of(F.col("category")))

    def scope(self) -> DataFrame:
        """Decided from the measures: rules end to end over the corpus, presence from the model's test rows, baselines from their file (category, naive, product)."""
        rules = evaluation.accuracy(measure.end_to_end(self.docs, self.annotations()), "category").select("category", F.col("pct").alias("measure"))
        detected = self.model().where("balanced is not null").select("category", "balanced", "recall")
        if self.baselines_path:
            known = readers.csv_table(self.spark, self.baselines_path).select("category", F.col("naive").cast("double").alias("naive"), F.col("product").cast("double").alias("product"))
        else:
            known = self.spark.createDataFrame([], "category string, naive double, product double")
        return kept(scope.decide(rules, detected, known))


def train(study: Study, out: str) -> tuple[DataFrame, DataFrame]:
    """Learn cue words on 60 % of the documents, thresholds on 20 %, measure on the rest; writes the model. (metric rows, summary)."""
    labels, docs, parts = kept(study.labels()), study.docs, kept(study.parts)
    part = lambda p: parts.where(F.col("part") == p).select("name")
    learned = labels.join(part("train"), "name", "left_semi")
    terms = learning.cue_terms(learning.document_frequency(docs.join(part("train"), "name", "left_semi"), learned), learned)
    cues = kept(learning.cue_table(terms, labels))
    rest = docs.join(parts.where("part <> 'train'"), "name")
    scored = windows.score(rest, cues).join(labels, ["name", "category"]).join(study.gold(), ["name", "category"], "left")
    scored = kept(scored.select("name", "part", "category", "score", "label", learning.located(F.col("text"), F.col("start"), F.col("gold")).alias("located")))
    found = learning.thresholds(learning.sweep(scored.where("part = 'val'")))
    rows = kept(learning.metrics(scored.where("part = 'test'").join(F.broadcast(found), "category")))
    writers.model_file(cues, labels.select("category").distinct().join(found, "category", "left"), learning.ordered(rows), out)
    return learning.ordered(rows), learning.summary(rows, labels)


def calibrate(study: Study, out: str) -> tuple[DataFrame, DataFrame]:
    """Confidence by distance from the threshold, fitted on validation documents, for the presence categories in scope; writes it. (bands on held-out documents, errors of one flat figure a category and of the calibrated ones)."""
    model = study.model().join(study.scope().where("in_scope and engine = 'presence'").select("category"), "category", "left_semi")
    docs = study.docs.join(study.parts.where("part <> 'train'"), "name")
    marked = readers.labels(study.annotations())
    scored = windows.score(docs, model.select("category", "cues")).drop("text").join(F.broadcast(model.select("category", "threshold", F.col("balanced"))), "category").join(marked, ["name", "category"])
    scored = kept(scored.select("part", "category", "score", "threshold", "balanced", "label"))
    fitted = kept(calibration.fit(calibration.observations(scored.where("part = 'val'"))))
    test = calibration.observations(scored.where("part = 'test'")).groupBy("category", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("actual"))
    flat = model.select("category", (F.col("balanced") / 100).alias("flat"))
    bands = test.join(F.broadcast(fitted), "category").join(F.broadcast(flat), "category").select("category", "bin", "n", F.coalesce(F.col("bins")[F.col("bin")], F.col("fallback")).alias("stated"), "actual", "flat")
    error = lambda column: calibration.expected_error(bands.select("n", "actual", F.col(column).alias("stated")))
    writers.calibration_file(fitted, calibration.EDGES, out)
    return bands.orderBy("category", "bin"), error("flat").withColumnRenamed("ece", "flat").crossJoin(error("stated").withColumnRenamed("ece", "calibrated"))


def floor(study: Study, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What the majority answer scores in each presence category; writes the report. (report, summary)."""
    long = study.annotations()
    floors = kept(evaluation.majority_floor(long.select("category", F.coalesce("answer", F.lit("")).alias("answer"))))
    report = evaluation.floor_report(floors, list(readers.answer_columns(readers.csv_table(study.spark, study.csv).columns)))
    if out:
        writers.floor_file(report, out)
    return report, evaluation.floor_summary(floors)


def rules(study: Study) -> tuple[DataFrame, DataFrame]:
    """Rules over marked passages: (accuracy by category, sample failures of categories under 95 %)."""
    judged = kept(measure.located(study.annotations()))
    rows = evaluation.accuracy(judged, "category")
    weak = rows.where("pct < 95").select("category")
    return rows.orderBy("category"), measure.failures(judged.join(F.broadcast(weak), "category", "left_semi")).orderBy("category", "place")


def end_to_end(study: Study) -> tuple[DataFrame, DataFrame]:
    """Rules over whole texts: (accuracy and what locating costs, annotations without a document)."""
    long, docs = study.annotations(), study.docs
    lost = long.select("name").distinct().join(docs.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    return measure.cost_of_locating(measure.end_to_end(docs, long), measure.located(long)).orderBy("category"), lost


def whole_sheet(study: Study) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sheet of held-out documents: (accuracy by category, summary, sheets by tenths of right rows)."""
    judged = kept(measure.whole_sheet(study.held_out(), study.annotations(), study.scope(), study.model()))
    by_sheet = evaluation.sheets(judged)
    return evaluation.accuracy(judged, "category", "engine").orderBy("engine", "category"), evaluation.sheet_summary(by_sheet), evaluation.sheet_deciles(by_sheet).orderBy(F.desc("decile"))


def bias(study: Study) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accuracy on held-out documents by agreement type and by length: (types, their gaps, quartiles, their gaps)."""
    docs = study.held_out()
    sizes = evaluation.length_quartiles(docs.select("name", F.length("text").alias("chars")), "chars").select("name", "quartile")
    judged = kept(measure.whole_sheet(docs, study.annotations(), study.scope(), study.model()).join(sizes, "name"))
    tally = lambda group: evaluation.accuracy(judged.select(F.col("category").alias("clause"), group.alias("grp"), "correct"), "clause", "grp")
    types, quarters = kept(tally(evaluation.agreement_type(F.col("name")))), kept(tally(F.col("quartile")))
    return evaluation.groups_by_size(types), evaluation.gap_verdict(types).orderBy("clause"), evaluation.groups_by_size(quarters), evaluation.gap_verdict(quarters).orderBy("clause")


def baseline(study: Study, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Naive readings against the product on held-out documents: (by category, means); writes (category, naive, product), which ``scope`` reads."""
    docs, long, decided = study.held_out(), study.annotations(), study.scope()
    a = evaluation.accuracy(measure.naive(docs, long, decided), "category").select("category", F.col("pct").alias("naive"))
    b = evaluation.accuracy(measure.whole_sheet(docs, long, decided, study.model()), "category").select("category", F.col("pct").alias("product"))
    rows = kept(a.join(b, "category").withColumn("gain", F.col("product") - F.col("naive"))).orderBy("category")
    if out:
        writers.csv_file(rows.select("category", "naive", "product"), out)
    return rows, rows.agg(F.avg("naive").alias("naive"), F.avg("product").alias("product"), F.avg("gain").alias("gain"))


def scope_lists(study: Study) -> tuple[DataFrame]:
    return (scope.ordered(study.scope()),)


def categories(spark: SparkSession, descriptions: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The category table from its descriptions; writes it as JSON and CSV. (counts by bucket, problems)."""
    table = kept(scope.categories(readers.category_table(spark, descriptions)))
    writers.categories_files(table, folder)
    return scope.bucket_counts(table).orderBy("bucket"), scope.validate(table)


def build_page(study: Study, out: str, wanted: list[str], add: list[str] = (), remove: list[str] = (), template: str | None = None) -> list[str]:
    """A page about a few documents; the names on it."""
    docs = kept(study.docs)
    names = page.choose(docs, wanted, add, remove)
    chosen, decided, model = kept(docs.where(F.col("name").isin(names))), study.scope(), study.model()
    measured = {r["category"]: r["measure"] for r in decided.where("engine = 'rule'").collect()}
    listed = [(c, bucket, measured[c]) for c, bucket in sheet.BUCKETS.items() if c in measured]
    rows = kept(sheet.scope_filter(sheet.sheet(chosen, listed, model), decided))
    tested = evaluation.accuracy(measure.whole_sheet(study.held_out(), study.annotations(), decided, model), "category").select("category", "pct")
    evidence = kept(evaluation.evidence(decided, tested))
    data = page.page_data(chosen, names, page.page_rows(chosen, rows, model, evidence))
    plain = lambda df: [r.asDict() for r in df.collect()]
    outside = plain(scope.ordered(decided.where("not in_scope")).select("category", "engine", "measure", "recall"))
    stamp = f"Built {datetime.date.today().isoformat()}, {len(names)} document" + ("s" if len(names) != 1 else "")
    writers.page_file(Path(template or TEMPLATE).read_text(encoding="utf-8"), out, stamp=stamp, data=data, evidence=plain(evidence), outside=outside)
    return names


def listing(study: Study) -> list[tuple[int, bool, str]]:
    """Number, whether held out, and name of each document, in the order of names."""
    names = [r["name"] for r in study.docs.select("name").orderBy("name").collect()]
    return [(i, i >= int(len(names) * learning.VALIDATE), n) for i, n in enumerate(names)]


def show(*tables: DataFrame) -> None:
    """Prints tables of any length up to a thousand rows."""
    for t in tables:
        t.show(1000, truncate=60)
