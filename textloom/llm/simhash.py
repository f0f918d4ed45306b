"""SimHash near-duplicates with deletion-variant signatures.

A document's fingerprint has a bit set where over half of its shingle hashes have
it. Two fingerprints link when at most ``distance`` bits differ.

Candidates. Cut the 64 bits into ``distance // 2 + 1`` segments: at most
``distance`` differing bits leave one segment with at most one of them. Each
segment is indexed once for each of its bits, with this bit blanked (a wildcard), so
segments within one bit share a key. Keys meet in an equality join; the pairs are
verified on all 64 bits. Only distinct fingerprints are indexed: a group of equal
texts costs one entry.

Crowded keys. A key that more than ``crowd`` distinct fingerprints share would
give a square of pairs. These fingerprints are instead linked through the points
of Hamming space around them: two of them are within a + b bits exactly if the a-ball
of one and the b-ball of the other share a point. All b-ball members of a point
hang on the point's smallest a-ball member. That is a fixed number of rows per fingerprint
however large the crowd is, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._common import join_hot, one_of_each, recovery_point, shuffle_width
from textloom.llm.components import connected_components

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        if len(words) <= shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[at + k : at + k + count] for k in range(shingle)), strict=True))
        hashes = np.fromiter((digest(g, seed) for g in grams), "<u8", count)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, tie, fp)``: the id, the text's xxhash64 and the signed form of its fingerprint; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "tie", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), text_col).mapInArrow(run, f"id {kind}, tie bigint, fp bigint")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def deletion_variants(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp)`` -> ``(key, fp)``: one row for each bit, its segment with this bit blanked."""
    segments = distance // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    rows = ", ".join(f"struct({at}L as at, {lo} as lo, {(1 << (hi - lo)) - 1 if hi - lo < 64 else -1}L as mask)" for lo, hi in zip(edges, edges[1:], strict=False) for at in range(lo, hi))
    wide = prints.repartition(4 * shuffle_width(prints.sparkSession), "fp")  # the table is small, what it becomes isn't
    wild = wide.select("fp", F.explode(F.expr(f"array({rows})")).alias("w"))
    # The blanked segment and the bit's number: together unique for distance 2 and more, else hashed apart.
    blanked = "(shiftrightunsigned(fp, w.lo) & w.mask & ~shiftleft(1L, cast(w.at - w.lo as int)))"
    return wild.select(F.expr(f"shiftleft({blanked}, 6) + w.at" if segments > 1 else f"xxhash64({blanked}, w.at)").alias("key"), "fp")


def _balls(radius: int) -> list[int]:
    """All masks of up to ``radius`` bits, in signed form."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _ball_points(prints: DataFrame, radius: int) -> DataFrame:
    masks = np.array(_balls(radius)).tolist()
    return prints.select("fp", F.explode(F.lit(masks)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))


def links(prints: DataFrame, distance: int = 2, crowd: int = 8) -> DataFrame:
    """Distinct ``(fp)`` -> ``(u, v)``: pairs that connect what lies within ``distance`` bits.

    Every returned pair is within the distance. Outside crowds all such pairs
    are returned (some twice); inside, as many as keep the same components.
    """
    if not 1 <= distance <= 3:
        raise ValueError("deletion variants are worth it for 1 to 3 differing bits")
    keyed = deletion_variants(prints, distance)
    shared = recovery_point(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    twos = shared.where("n = 2").select("u", "v").where(near)
    members = recovery_point(keyed.join(shared.where("n > 2").select("key", "n"), "key"))
    few = members.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("all"))
    few = few.select("all", F.explode("all").alias("u")).select("u", F.explode(F.expr("filter(all, x -> x > u)")).alias("v")).where(near)
    packed = members.where(F.col("n") > crowd).select("fp").distinct()
    inner = _ball_points(packed, distance // 2).groupBy("point").agg(F.min("fp").alias("v"))
    outer = _ball_points(packed, distance - distance // 2)
    crowded = outer.join(inner, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return twos.unionByName(few).unionByName(crowded)


def _rooted(prints: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``(fp, root)`` of every fingerprint."""
    own = prints.select("fp").distinct()
    found = connected_components(links(own, distance, crowd))
    return recovery_point(own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, crowd: int = 8, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, fp, component_id)``.

    ``component_id`` is the smallest id reachable over links, its own included.
    Null and blank texts have fingerprint zero and link like any other; long texts are read whole. Null ids
    take part but never name a component (null if a component has no other); rows with
    one id twice each get their row. Other columns aren't read. An empty table gives an empty result.
    """
    prints = recovery_point(with_fingerprints(docs, id_col, text_col, shingle, seed))
    rooted = _rooted(prints, distance, crowd)
    name = "component_id" if id_col.lower() != "component_id" else "component_id_"
    lowest = prints.groupBy("fp").agg(F.min("id").alias("least")).join(rooted, "fp").groupBy("root").agg(F.min("least").alias(name))
    return join_hot(prints, rooted.join(lowest, "root").select("fp", name), "fp").select(F.col("id").alias(id_col), "fp", name)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, crowd: int = 8, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each component, as ``one_of_each`` says: that of the smallest id; exact repeats and copies with a null id go too."""
    prints = recovery_point(with_fingerprints(docs, id_col, text_col, shingle, seed))
    members = recovery_point(join_hot(prints, _rooted(prints, distance, crowd), "fp").select("id", "tie", "root"))
    return one_of_each(docs, members, id_col, text_col)
