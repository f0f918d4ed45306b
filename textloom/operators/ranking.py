"""Global row numbers without a single-partition window."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster)."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint(eager=True)


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """Row numbers from 0 in the order of columns, and the number of rows.

    A range partitioning, sorted inside and kept, so that the numbers don't depend on how often it is read; the driver gets one count for each partition.
    """
    spark = df.sparkSession
    width = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = kept(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    starts, total = [], 0
    for part, n in sorted(sorted_.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part bigint, _from bigint")
    ranked = sorted_.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_from") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return ranked.select(*df.columns, name), total
