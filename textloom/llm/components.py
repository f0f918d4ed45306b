"""Connected components of an undirected graph by alternating star contraction.

Every round is two grouped minima and two equality joins over the edge table; no
group is gathered into one task and nothing but two numbers reaches the driver. Once
the table is so small that one task reads it anyway, this task does the rest: a round's plans cost the driver
the same memory however few edges there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from textloom.llm._common import recovery_point

#: Edges that a task reads at least, where there are so many: small tables in many partitions would cost more in files than in rows.
EDGES = 20_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each smaller neighbour, and the node itself, on its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(low.select("u", F.col("m").alias("v")))


def _by_one_task(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of a small table of whole numbers: sets of nodes that hang on their smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(u), top(v)))
                above[high] = low
        found = [(x, r) for x in above if (r := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in (0, 1)], ["node", "root"])

    name = edges.schema["u"].dataType.simpleString()
    kind = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}.get(name, pa.int64())
    return edges.coalesce(1).mapInArrow(run, f"node {name}, root {name}")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)``, two columns of one orderable type without nulls -> ``(node, root)``.

    ``root`` is the smallest node reachable. Nodes without an edge to another
    node don't appear. An empty edge table gives an empty result. Each round is
    written to the checkpoint folder; the loop ends when the edge table repeats, after a number of rounds that grows with the logarithm of the nodes,
    or when it has at most ``EDGES`` rows, which one task connects.
    """
    now = recovery_point(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if mark[0] == 0 or mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if mark[0] <= EDGES and isinstance(now.schema["u"].dataType, IntegralType):
            return recovery_point(_by_one_task(now))
        last = mark
        now = now.coalesce(mark[0] // EDGES + 1)
        now = recovery_point(_small_star(recovery_point(_large_star(now))).distinct())
