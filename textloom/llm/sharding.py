"""Reproducible shuffle into shards: a Feistel permutation with cycle walking.

Rows get gapless global row numbers that depend on their content only. A keyed
Feistel network permutes the numbers 0 to n - 1: it permutes the smallest even number of
bits that covers n, and a number that lands at n or above goes through again until it is
below (cycle walking). Place p lies in shard p mod shards, slot p div shards, so shard sizes
differ by one row at most, slots have no gaps, and both directions are computable without a table.

Row numbers: rows are dealt by a content hash over many small buckets; the bucket counts, a
few numbers for each million rows, give offsets; inside a bucket rows are ordered by the
hash and the sort columns. One shuffle of the rows, no global sort.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm._common import free_name, shuffle_width

ROUNDS = 6
#: Rows that a bucket of row numbers holds on average at most, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 4096


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """A fixed 64-bit mixing function of x and the round's key (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _round_keys(seed: int) -> list[int]:
    return [int(_scramble(np.array([r], np.uint64), (seed * 0x10001 + r) % (1 << 64))[0]) for r in range(1, ROUNDS + 1)]


def permute(numbers: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``, or its inverse."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(seed)
    out = np.array(numbers, dtype=np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_scramble(left, key) & mask), left
            else:
                left, right = right, left ^ (_scramble(right, key) & mask)
        x = (left << half) | right
        out[todo] = x
        todo[todo] = x >= n
    return out.astype(np.int64)


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def with_row_numbers(df: DataFrame, hash_of: list[Column], sort: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers from 0 in column ``name``, and the number of rows.

    ``hash_of``: what a row's bucket depends on; ``sort``: columns that break ties of the hash. Rows equal
    in all of them are interchangeable. The driver gets one count for each bucket.
    """
    spark = df.sparkSession
    buckets = max(LEAST_BUCKETS, 8 * shuffle_width(spark))
    h, b, off = free_name(df, "h"), free_name(df, "bucket"), free_name(df, "offset")
    hashed = df.withColumn(h, F.xxhash64(*hash_of))
    total = None
    while True:
        dealt = hashed.withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
        counts = dict(dealt.groupBy(b).count().collect())
        total = sum(counts.values())
        if total <= buckets * BUCKET_ROWS:
            break
        buckets = -(-total // BUCKET_ROWS)
    sizes = [counts.get(i, 0) for i in range(buckets)]
    starts = spark.createDataFrame(pd.DataFrame({b: np.arange(buckets, dtype=np.int64), off: np.array([0, *accumulate(sizes)][:-1], dtype=np.int64)}))
    order = Window.partitionBy(b).orderBy(h, *sort)
    ranked = dealt.withColumn(name, F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(starts), b).withColumn(name, F.col(name) + F.col(off))
    return joined.select(*df.columns, name), total


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` with columns shard (int, from 0) and slot (long, from 0) appended.

    All rows get a place: null ids, null and empty and very long texts, and repeated rows, which get one place
    each (rows equal in id and text are interchangeable). Names that ``df`` has already get an underscore appended. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    at = free_name(df, "row_number")
    numbered, n = with_row_numbers(df, [F.col(id_col), F.col(text_col)], [id_col, text_col], at)
    place = F.pandas_udf(lambda rows: pd.Series(permute(rows.to_numpy(), n, seed)), "bigint")
    p = free_name(numbered, "place")
    shard, slot = free_name(df, names[0]), free_name(df, names[1])
    placed = numbered.withColumn(p, place(F.col(at)))
    return placed.select(*df.columns, F.pmod(p, F.lit(shards)).cast("int").alias(shard), F.expr(f"{p} div {shards}").alias(slot))
