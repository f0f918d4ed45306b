"""Mixing whole document tables: sources of a table's own column, fair targets, copies.

Handles nulls (a null source is a source, the last one; a null text has no words), empty texts (never
picked as an extra copy, as they add nothing, but repeated with their whole source), repeated rows (each counts), equal
sizes (the seeded hash decides; rows with one id and text go together), very long texts (one that doesn't fit a gap is passed over) and empty tables (empty result).
A source column that holds arrays puts a document in several sources (none: in the null source); its target is then the sum of theirs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm import mixing
from textloom.llm._common import recovery_point

#: Weights of the sources by rank, repeating; words of the mix for each word there is; copies at most.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2


def _measured(docs: DataFrame, source_col: str, id_col: str, text_col: str, seed: int, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` as c0, c1, ..., with pattern, size and h."""
    own = {c: f"c{i}" for i, c in enumerate(columns)}
    several = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    sources = F.coalesce(F.col(own[source_col]), F.array(F.lit(None).cast("string"))) if several else F.array(own[source_col])
    renamed = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in own.items()))
    return mixing.measure(renamed, sources, mixing.words_of(F.col(own[text_col])), mixing.seeded_hash(seed, F.col(own[id_col]), F.col(own[text_col])))


def plan_for(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS):
    """The plan table for ``sized(pattern, size, h)`` with pattern_size and target appended."""
    sizes = mixing.pattern_sizes(sized)
    patterns = {p: tuple(json.loads(p)) for p in sizes}
    sources = sorted({s for p in patterns.values() for s in p}, key=lambda s: (s is None, s or ""))
    held = {s: sum(sizes[p] for p, of in patterns.items() if s in of) for s in sources}
    ranked = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    targets = mixing.fair_targets(held, ranked, share * sum(sizes.values()), repeats)
    ordered = sorted(patterns)
    flow = mixing.cheapest_flow({patterns[p]: sizes[p] for p in ordered}, {s: round(targets[s]) for s in sources}, repeats)
    amounts = {p: (sizes[p], min(sum(flow[patterns[p]].values()), repeats * sizes[p])) for p in ordered}
    plan = mixing.plan_mix(sized, amounts)
    plan["pattern_size"] = [sizes[p] for p in plan["pattern"]]
    plan["target"] = [float(sum(targets[s] for s in patterns[p])) for p in plan["pattern"]]
    return plan


def _plan_frame(spark, plan) -> DataFrame:
    return spark.createDataFrame(plan, f"{mixing.PLAN_SCHEMA}, pattern_size bigint, target double")


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words, repeats counted)."""
    sized = recovery_point(_measured(docs, source_col, id_col, text_col, seed, [id_col, source_col, text_col]).select("c0", "pattern", "size", "h"))
    plan = _plan_frame(docs.sparkSession, plan_for(sized))
    joined = sized.join(F.broadcast(plan), "pattern")
    return joined.select(F.col("c0").alias(id_col), "size", F.col("pattern_size").alias("source_size"), "target", (F.col("size") * mixing.copies_taken("size", "h")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken.

    The plan is made on a narrow table; the texts are read once more and don't move between executors.
    """
    measured = _measured(docs, source_col, id_col, text_col, seed, docs.columns)
    sized = recovery_point(measured.select("pattern", "size", "h"))
    plan = _plan_frame(docs.sparkSession, plan_for(sized))
    taken = measured.join(F.broadcast(plan), "pattern").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    taken = taken.where(F.col("copy") <= mixing.copies_taken("size", "h"))
    return taken.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
