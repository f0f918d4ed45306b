"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by their set of sources
(the pattern). Each pattern offers its words once for free, a second time at a cost, a third time
at a higher one (convex), and routes them to its sources, each of which takes
up to its quota. The cheapest largest flow tells how many words each pattern gives. Then
each pattern repeats all its documents as often as that goes evenly and picks seeded documents for the rest.

Picking: each document has a seeded hash; those up to a limit are picked. The limit is
found by histograms over the hash that narrow down to the document at which the running sum meets the
rest, so no pattern, however large, is sorted or gathered in one task. What then is
still missing is filled in the same way from documents no larger than the gap, until no such document is left.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm._common import recovery_point

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns and sources that the driver plans with at most.
MAX_PATTERNS = 100_000
#: Hash bits that one histogram resolves; rows of a bin that are then ordered exactly.
BITS, EXACT_ROWS = 12, 20_000


def fair_targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float, repeats: int = 2) -> dict[str | None, float]:
    """Shares of ``total`` by weight; none above ``repeats`` times its source's size, the excess reshared by weight."""
    out: dict[str | None, float] = {}
    open_ = dict(weights)
    while open_:
        left, unit = total - sum(out.values()), sum(open_.values())
        over = [s for s, w in open_.items() if left * w / unit > repeats * sizes[s]]
        if not over:
            return out | {s: left * w / unit for s, w in open_.items()}
        for s in over:
            out[s] = float(repeats * sizes[s])
            del open_[s]
    return out


def cheapest_flow(offers: Mapping[tuple, int], quotas: Mapping[str | None, int], repeats: int = 2) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources: largest flow of least cost.

    The r-th copy of a pattern's words costs r - 1 a word. Costs arise only where words leave the start, so a cheapest path never takes words
    back from a pattern: the flow is largest and cheapest if it is largest with first copies only, then grows as far as second copies allow, and so on. Each
    of these is a largest flow by blocking flows over shortest paths. Ties go by the order of the inputs.
    """
    patterns, sources = list(offers), list(quotas)
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    routes = [[number[s] for s in p if s in number] for p in patterns]
    given: list[dict[int, int]] = [dict.fromkeys(r, 0) for r in routes]
    back: dict[int, list[int]] = {number[s]: [] for s in sources}
    for i, r in enumerate(routes):
        for s in r:
            back[s].append(i)
    room = {number[s]: quotas[s] for s in sources}
    left = [0] * len(patterns)

    def levels() -> dict[int, int]:
        """Steps from a pattern with words left, over routes and back over what was given."""
        depth = {i: 0 for i, n in enumerate(left) if n > 0}
        queue = deque(depth)
        while queue:
            u = queue.popleft()
            for v in routes[u] if u < len(patterns) else (p for p in back[u] if given[p][u] > 0):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        return depth

    def push(i: int, depth: dict[int, int], arcs: dict[int, list[int]]) -> int:
        """Send words of pattern i to a source with room; 0 if that can't be done any more on shortest paths."""
        path = [i]
        while path:
            u = path[-1]
            if u >= len(patterns) and room[u] > 0:
                amount = min(left[i], room[u], *(given[v][w] for w, v in zip(path[1::2], path[2::2], strict=False)))
                left[i] -= amount
                room[u] -= amount
                for a, b in zip(path, path[1:], strict=False):
                    if a < len(patterns):
                        given[a][b] += amount
                    else:
                        given[b][a] -= amount
                return amount
            if u not in arcs:
                arcs[u] = [v for v in (routes[u] if u < len(patterns) else back[u]) if depth.get(v) == depth[u] + 1][::-1]
            while arcs[u] and u >= len(patterns) and given[arcs[u][-1]][u] == 0:
                arcs[u].pop()
            if arcs[u]:
                path.append(arcs[u][-1])
            else:
                path.pop()
                if path:
                    arcs[path[-1]].pop()
        return 0

    for _ in range(repeats):
        left = [n + offers[p] for n, p in zip(left, patterns, strict=True)]
        while True:
            depth, arcs, moved = levels(), {}, 0
            for i in [i for i, n in enumerate(left) if n > 0]:
                while left[i] > 0 and (amount := push(i, depth, arcs)):
                    moved += amount
            if not moved:
                break
    return {p: {s: given[i][number[s]] for s in p if s in number} for i, p in enumerate(patterns)}


def pattern_of(sources: Column) -> Column:
    """A text key for the set of sources: sorted, without repeats, null last."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _unsigned_bits(h: str, done: int) -> Column:
    """The next BITS bits of the hash, as an unsigned number, after ``done`` bits."""
    take = min(BITS, 64 - done)
    return F.shiftrightunsigned(F.shiftleft(F.col(h), done), 64 - take)


def _key_order(h: str) -> Column:
    """Signed order of this column is the unsigned order of the hash."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def _limits(rows: DataFrame, need: dict[str, int], spark) -> dict[str, tuple[int, int]]:
    """For each pattern in ``need``: the highest order key up to which ``rows(pattern, size, h)`` sum to at most its need, and their sum.

    Patterns without such a row are left out. The driver gets a few numbers a pattern.
    """
    need = {p: n for p, n in need.items() if n > 0}
    at = {p: 0 for p in need}  # words below the bin looked into
    rows, done, found = rows, 0, {}
    while at:
        now = spark.createDataFrame(pd.DataFrame({"pattern": list(at), "room": [need[p] - at[p] for p in at]}))
        rows = rows.join(F.broadcast(now), "pattern")
        bins = rows.withColumn("bin", _unsigned_bits("h", done)).groupBy("pattern", "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max(_key_order("h")).alias("key"), F.first("room").alias("room"))
        run = F.sum("size").over(Window.partitionBy("pattern").orderBy("bin"))
        bins = bins.withColumn("upto", run)
        fit = F.col("upto") <= F.col("room")
        got = bins.groupBy("pattern").agg(F.max(F.when(fit, F.col("upto"))).alias("sum"), F.max(F.when(fit, F.col("key"))).alias("key"), F.min(F.when(~fit, F.struct("bin", "n"))).alias("next")).collect()
        done += BITS
        crossing, largest = {}, 0
        for r in got:
            if r["sum"] is not None:
                found[r["pattern"]] = (r["key"], at[r["pattern"]] + r["sum"])
                at[r["pattern"]] += r["sum"]
            if r["next"] is not None:
                crossing[r["pattern"]] = r["next"]["bin"]
                largest = max(largest, r["next"]["n"])
        if not crossing:
            break
        inside = spark.createDataFrame(pd.DataFrame({"pattern": list(crossing), "want": list(crossing.values())}))
        rows = rows.drop("room").join(F.broadcast(inside), "pattern").where(_unsigned_bits("h", done - BITS) == F.col("want")).drop("want")
        at = {p: at[p] for p in crossing}
        if largest <= EXACT_ROWS or done >= 60:
            now = spark.createDataFrame(pd.DataFrame({"pattern": list(at), "room": [need[p] - at[p] for p in at]}))
            # Equal hashes go together and are summed first: the window holds at most EXACT_ROWS rows, or a last bin's few hashes, of a pattern.
            once = rows.join(F.broadcast(now), "pattern").groupBy("pattern", _key_order("h").alias("key")).agg(F.sum("size").alias("size"), F.first("room").alias("room"))
            frame = Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
            last = once.withColumn("upto", F.sum("size").over(frame)).where("upto <= room")
            for r in last.groupBy("pattern").agg(F.max("upto").alias("sum"), F.max("key").alias("key")).collect():
                found[r["pattern"]] = (r["key"], at[r["pattern"]] + r["sum"])
            break
    return found


def plan_mix(sized: DataFrame, amounts: Mapping[str, tuple[int, int]]) -> pd.DataFrame:
    """How to pick: for each pattern ``whole`` copies of all its documents, and one more of those by ``rules``.

    ``sized(pattern, size, h)`` should be cheap to read again. ``amounts``: pattern -> (its words, words to take).
    A rule (most, key) picks documents of at most ``most`` words whose order key is at most ``key``. Each round leaves a gap smaller than the one before, or
    no document that fits; what is left to look at is written down in between, so plans stay short.
    """
    spark = sized.sparkSession
    whole = {p: (take // size if size else 0) for p, (size, take) in amounts.items()}
    gap = {p: take - whole[p] * size for p, (size, take) in amounts.items()}
    rules: dict[str, list[tuple[int, int]]] = {p: [] for p in amounts}
    left = sized.where("size > 0")
    while most := {p: g for p, g in gap.items() if g > 0}:
        bound = spark.createDataFrame(pd.DataFrame({"pattern": list(most), "most": list(most.values())}))
        left = recovery_point(left.join(F.broadcast(bound), "pattern").where("size <= most").drop("most"))
        limits = _limits(left, most, spark)
        if not limits:
            break
        for p, (key, total) in limits.items():
            rules[p].append((most[p], key))
            gap[p] -= total
        done = spark.createDataFrame(pd.DataFrame({"pattern": list(limits), "key": [k for k, _ in limits.values()]}))
        left = left.join(F.broadcast(done), "pattern").where(_key_order("h") > F.col("key")).drop("key")
    return pd.DataFrame({"pattern": list(amounts), "whole": [whole[p] for p in amounts], "rules": [[{"most": int(m), "key": int(k)} for m, k in rules[p]] for p in amounts]})


PLAN_SCHEMA = "pattern string, whole bigint, rules array<struct<most: bigint, key: bigint>>"


def copies_taken(size: str, h: str) -> Column:
    """Copies of a document, given the columns of its pattern's plan."""
    key = _key_order(h)
    extra = F.exists("rules", lambda r: (F.col(size) <= r["most"]) & (key <= r["key"])) & (F.col(size) > 0)
    return F.col("whole") + F.when(extra, 1).otherwise(0)


def seeded_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def measure(docs: DataFrame, sources: Column, size: Column, order: Column) -> DataFrame:
    """``docs`` with pattern, size and h appended; give it columns of other names."""
    return docs.select("*", pattern_of(sources).alias("pattern"), size.alias("size"), order.alias("h"))


def pattern_sizes(sized: DataFrame) -> dict[str, int]:
    """Words of each pattern. More patterns than the driver can plan with raise ValueError."""
    got = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns: group sources first")
    return {r["pattern"]: r["size"] for r in got}
