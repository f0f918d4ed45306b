"""The sheet over arriving documents. It keeps no state: rows of a document depend on that document alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import sheet


def documents(spark: SparkSession, path: str, schema: str = "name string, text string", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sheet_stream(docs: DataFrame, rules: list[tuple[str, str, float]], model: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the sheet's rows as Parquet; each document exactly once, over restarts too."""
    rows = sheet.sheet(docs, rules, model)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
