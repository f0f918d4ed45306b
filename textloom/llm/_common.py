"""What the corpus operators share: recovery points, column names, word splitting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one tokenizing step holds at a time in a Python worker.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def recovery_point(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder. Use it on narrow tables: the rows are written once and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, a recovery point, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows (a key and a hash) that ``without`` broadcasts at most.
MOST_KEYS = 500_000


def _matching(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    same = F.col(f"a.`{id_col}`").eqNullSafe(F.col("b.id")) & (F.xxhash64(F.col(f"a.`{text_col}`")) == F.col("b.tie"))
    return docs.alias("a").join(bounded(keys, MOST_KEYS).alias("b"), same, how).select(*(F.col(f"a.`{c}`") for c in docs.columns))


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text's hash aren't among ``keys(id, tie)``, of a recovery point. Texts don't move while the keys are few."""
    return _matching(docs, keys, id_col, text_col, "left_anti")


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each group of ``members(id, tie, root)``, a recovery point with one row per row of ``docs``.

    The row of the smallest id stays (null ids last; of one id the smallest hash of the text; of rows equal in both the smallest hash of the
    whole row). Only rows that are repeated as a whole move between executors while the dropped keys are few.
    """
    keys = members.groupBy("root", "id", "tie").agg(F.count(F.lit(1)).alias("n"))
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie")).alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    judged = recovery_point(join_hot(keys, first, "root", members).select("id", "tie", "n", stays.alias("stays")).where("n > 1 or not stays"))
    left = without(docs, judged.where("not stays").select("id", "tie"), id_col, text_col)
    repeated = judged.where("stays").select("id", "tie")
    if repeated.isEmpty():
        return left
    whole = _matching(left, repeated, id_col, text_col, "left_semi").select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"))
    own = f"row.c{docs.columns.index(id_col)}", f"row.c{docs.columns.index(text_col)}"
    once = whole.groupBy(F.col(own[0]).alias("id"), F.xxhash64(own[1]).alias("tie")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return without(left, repeated, id_col, text_col).unionByName(once.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, in which ``key`` is unique, where single keys may hold much of ``left``.

    Keys with over 1 / (8 * width) of the rows (of ``rows``, else of ``left``: a recovery point) are fewer than 8 * width: their part of ``right`` is
    broadcast, and their rows stay where they are. The others are joined by a shuffle.
    """
    rows, kind = left if rows is None else rows, left.schema[key].dataType.simpleString()
    most = max(1, rows.count() // (8 * shuffle_width(left.sparkSession)))
    hot = [tuple(r) for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key).collect()]
    if not hot:
        return left.join(right, key)
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, f"{key} {kind}"))
    return left.join(F.broadcast(right.join(keys, key, "left_semi")), key).unionByName(left.join(keys, key, "left_anti").join(right, key))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that starts as ``base`` and that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at a space or line end, so that no token is cut."""
    start, end = 0, len(data)
    while end - start > size:
        cut = min((p for p in (data.find(b" ", start + size), data.find(b"\n", start + size)) if p >= 0), default=-1)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]
