"""Jobs over a corpus of documents: python -m textloom JOB --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from textloom import jobs
from textloom.operators import page, sheet
from textloom.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    jobs_ = top.add_subparsers(dest="job", required=True)

    def job(name: str, says: str, *options: str) -> argparse.ArgumentParser:
        p = jobs_.add_parser(name, help=says, description=says)
        if "corpus" in options:
            p.add_argument("--corpus", required=True, help="JSON map of names and texts, PATH/*.txt, or Parquet (name, text)")
        if "annotations" in options:
            p.add_argument("--annotations", required=True, help="CSV with a span and an answer column for each category")
        if "model" in options:
            p.add_argument("--model", default="model.json")
            p.add_argument("--calibration", default="calibration.json")
            p.add_argument("--baselines", help="CSV (category, naive, product)")
        if "out" in options:
            p.add_argument("--out")
        return p

    one = job("sheet", "the sheet of one document", "corpus", "model")
    one.add_argument("document", nargs="?", default="0", help="number in the order of names, or a part of the name")
    job("train", "learn cue words and thresholds, and measure them", "corpus", "annotations", "model", "out")
    job("calibrate", "fit the confidence of single rows", "corpus", "annotations", "model", "out")
    job("floor", "what the majority answer scores", "annotations", "out")
    job("rules", "rules over marked passages", "annotations")
    job("e2e", "rules over whole texts", "corpus", "annotations")
    job("accuracy", "the whole sheet on held-out documents", "corpus", "annotations", "model")
    job("bias", "accuracy by agreement type and length", "corpus", "annotations", "model")
    job("baseline", "naive readings against the product", "corpus", "annotations", "model", "out")
    job("scope", "which categories may answer alone", "corpus", "annotations", "model")
    table = job("categories", "the category table")
    table.add_argument("descriptions")
    table.add_argument("folder")
    built = job("page", "an HTML page about a few documents", "corpus", "annotations", "model", "out")
    built.add_argument("--template")
    built.add_argument("--contracts", nargs="*", default=["0"])
    built.add_argument("--add", nargs="*", default=[])
    built.add_argument("--remove", nargs="*", default=[])
    built.add_argument("--list", action="store_true")
    return top


def print_sheet(spark: SparkSession, corpus: str, model: str, calibration: str, wanted: str) -> None:
    docs = readers.corpus(spark, corpus)
    name = page.resolve(docs, wanted)
    learned = readers.model(spark, model, calibration).withColumn("bucket", F.lit("retrieval"))
    rows = sheet.sheet(docs.where(F.col("name") == name), sheet.MEASURED, learned)
    print(name)
    jobs.show(sheet.display_order(rows).select("state", "category", "value", "confidence", "start"), sheet.footer(rows))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if a.job == "sheet":
        return print_sheet(spark, a.corpus, a.model, a.calibration, a.document)
    if a.job == "categories":
        return jobs.show(*jobs.categories(spark, a.descriptions, a.folder))
    model = (a.model, a.calibration, a.baselines) if hasattr(a, "model") else ()
    study = jobs.Study(spark, getattr(a, "corpus", None), getattr(a, "annotations", None), *model)
    if a.job == "page" and a.list:
        return print(*(f"{i:>4} {'held out' if h else '        '}  {n}" for i, h, n in jobs.listing(study)), sep="\n")
    if a.job == "page":
        return print(*jobs.build_page(study, a.out or "page.html", a.contracts, a.add, a.remove, a.template), sep="\n")
    run = {"train": jobs.train, "calibrate": jobs.calibrate, "floor": jobs.floor, "rules": jobs.rules, "e2e": jobs.end_to_end, "accuracy": jobs.whole_sheet, "bias": jobs.bias, "baseline": jobs.baseline, "scope": jobs.scope_lists}[a.job]
    out = {"train": a.model, "calibrate": a.calibration}.get(a.job) if hasattr(a, "model") else None
    return jobs.show(*(run(study, a.out or out) if hasattr(a, "out") else run(study)))


if __name__ == "__main__":
    main()
