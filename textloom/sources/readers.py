"""Readers. All give DataFrames with a fixed schema; parquet is the form for large corpora."""

from __future__ import annotations

import ast
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textloom.functions.text import key_of, plain_key, stem

SUFFIXES = ("-Answer", "- Answer")


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of names and texts -> (name, text)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "text"))


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one a document; the name is the file's without .txt. Bytes that aren't UTF-8 are replaced."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("file", r"(?i)\.txt$", "").alias("name"), "text")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a JSON file, a folder of text files (``…/*.txt``) or Parquet, by the path's ending."""
    read = corpus_json if path.endswith(".json") else corpus_texts if path.endswith(".txt") else corpus_parquet
    return read(spark, path)


def corpus_parquet(spark: SparkSession, path: str, name: str = "name", text: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(name).cast("string").alias("name"), F.col(text).alias("text"))


def first_existing(*candidates: str) -> str | None:
    """The first of several local paths at which there is a file."""
    return next((c for c in candidates if Path(c).is_file()), None)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quoted cells of several lines, doubled quotes, and perhaps a byte order mark."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.toDF(*(c.lstrip("﻿") for c in raw.columns))


def _literal(cell: str | None):
    """What a cell's list literal says, the cell itself where it is none, an empty list for a blank one."""
    cell = (cell or "").strip()
    if not cell:
        return []
    try:
        return ast.literal_eval(cell)
    except (ValueError, SyntaxError):
        return [cell]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(cells: pd.Series) -> pd.Series:
    return cells.map(lambda cell: [str(x) for x in v] if isinstance(v := _literal(cell), list) else [str(v)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _training_spans(cells: pd.Series) -> pd.Series:
    return cells.map(lambda cell: [str(x) for x in v] if isinstance(v := _literal(cell), (list, tuple, str, set, dict)) else [str(v)])


def spans_of(cell: Column, training: bool = False) -> Column:
    """The passages in a cell: a list literal's elements, else the cell itself; none if blank.

    A literal that is no list is one passage for the rules; for training its parts are (a string's characters). The
    cells are list literals of another language, with its escapes, which no built-in function reads.
    """
    return _training_spans(cell) if training else _spans(cell)


def answer_columns(columns: list[str]) -> dict[str, str]:
    """Category -> its answer column, by exact suffix."""
    return {c: c + s for c in columns for s in SUFFIXES if c + s in columns}


def answer_columns_by_key(columns: list[str]) -> dict[str, str]:
    """Category -> its answer column, by key: names that differ in case and signs belong together."""
    answers = {plain_key(c.removesuffix(s)): c for c in columns for s in SUFFIXES if c.endswith(s)}
    return {c: answers[plain_key(c)] for c in columns if not c.endswith("Answer") and plain_key(c) in answers}


def annotations(wide: DataFrame, file: str = "Filename", match_keys: bool = False, training: bool = False) -> DataFrame:
    """One wide row a document -> (name, category, spans, answer); answers are trimmed, null if the cell is.

    ``match_keys``: answer columns by key instead of by exact name. ``training``: span cells as training reads them.
    """
    answers = answer_columns_by_key(wide.columns) if match_keys else answer_columns(wide.columns)
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("cell"), F.trim(F.col(f"`{a}`")).alias("answer")) for c, a in answers.items()))
    long = wide.select(stem(F.col(file)).alias("name"), F.explode(cells).alias("c")).select("name", "c.*")
    return long.select("name", "category", spans_of(F.col("cell"), training).alias("spans"), "answer")


def labels(long: DataFrame) -> DataFrame:
    """(name, category, label): whether a passage is given. Not what the answer says."""
    return long.select("name", "category", (F.size("spans") > 0).alias("label"))


def by_key(table: DataFrame, names: DataFrame, column: str = "category") -> DataFrame:
    """``table`` joined with ``names`` on their category's key, as files write names differently."""
    right = names.withColumnRenamed(column, "named").withColumn("_key", key_of(F.col("named")))
    return table.withColumn("_key", key_of(F.col(column))).join(F.broadcast(right), "_key", "left").drop("_key")


def category_table(spark: SparkSession, path: str) -> DataFrame:
    """The category descriptions' four columns; an empty file raises ValueError."""
    raw = csv_table(spark, path)
    if not raw.columns:
        raise ValueError(f"empty: {path}")
    return raw.toDF("category", "description", "format", "group")


MODEL_SCHEMA = "thresholds map<string,double>, cues map<string,array<string>>, test array<struct<category: string, n: int, positives: int, floor: double, accuracy: double, balanced: double, recall: double, specificity: double, located_pct: double>>"
CALIBRATION_SCHEMA = "map<string,struct<bins: map<string,double>, fallback: double, edges: array<double>>>"


def model(spark: SparkSession, path: str, calibration: str | None = None) -> DataFrame:
    """The learned model: (category, cues, threshold, recall, balanced, located_pct, bins, fallback). A missing calibration file leaves the last two empty; a missing model is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", MODEL_SCHEMA).alias("m"))
    rows = whole.select(F.explode("m.cues").alias("category", "cues"), F.col("m.thresholds").alias("t"), F.col("m.test").alias("tests"))
    test = F.get(F.filter("tests", lambda r: r["category"] == F.col("category")), F.lit(0))
    read = rows.select("category", "cues", F.col("t")[F.col("category")].alias("threshold"), *(test[c].alias(c) for c in ("recall", "balanced", "located_pct")))
    if calibration is None or not Path(calibration).is_file():
        return read.withColumn("bins", F.lit(None).cast("map<int,double>")).withColumn("fallback", F.lit(None).cast("double"))
    fitted = spark.read.text(calibration, wholetext=True).select(F.explode(F.from_json("value", CALIBRATION_SCHEMA)).alias("category", "c"))
    return read.join(fitted.select("category", F.col("c.bins").cast("map<int,double>").alias("bins"), F.col("c.fallback").alias("fallback")), "category", "left")
