"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates. A text's shingles are hashed and ``BANDS`` keys are made of ``ROWS`` minimum hashes each; texts that share a
key are candidates. A pair of similarity s shares none with probability (1 - s ** ROWS) ** BANDS: 1e-6 at 0.8 and less
above. (SimHash differs in about 7 of 64 bits for such pairs and up to twice that, too many for short segments.) Every
candidate is then verified on its whole shingle sets. Only distinct sets are indexed: equal texts cost one entry.

Keys of up to ``CROWD`` distinct sets give all their pairs, and groups are what these links connect. Crowded keys would give a
square of pairs. In them

* a shingle that no other set of the crowds holds can't be shared: with c shared shingles of n, a set can be similar to no other
  unless c >= 0.8 n, and to a given one only if both c reach 4/9 of the sum of both n. So texts that merely have a passage in common drop out. This is exact;
* all members are compared with the one that has the largest part shared (of copies, mostly what they were copied from), which puts most of them in one group;
* what is left to decide are pairs of different groups. All of them are compared: the members of a key that holds several groups are dealt to blocks, every two blocks
  (but for two of the largest group) meet in one task, and only links that join groups come out. So rows grow with the members times the blocks, not with the pairs.

So groups are the same as if all pairs in crowded keys had been listed.

Links of SimHash (``simhash.links``) are taken too, so that a group here contains the groups found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm import simhash
from textloom.llm._common import MOST_KEYS, bounded, join_hot, one_of_each, recovery_point
from textloom.llm.components import connected_components

SHINGLE, BANDS, ROWS, CROWD = 5, 35, 5, 8
#: Shingles of the sets in a block, about.
DEALT = 1 << 17
#: Minimum hashes over so many shingles at a time; words whose hashes a task keeps.
BLOCK, CACHE = 1024, 300_000
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS + SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND, _PLACE = _ODD[: BANDS * ROWS], _ODD[BANDS * ROWS : -1]


class _Words(dict):
    """Hashes of words seen, as a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of a shorter text, one of all its words; none without words."""
    found = (text or "").encode().lower().split()
    one = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(one) - SHINGLE + 1) if len(one) else 0
    total = np.full(n, min(len(one), SHINGLE), np.uint64)
    for k in range(min(len(one), SHINGLE)):
        total += _mixed(one[k : k + n] * _PLACE[k])
    return np.unique(_mixed(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of one shingle set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * _BAND).min(axis=0), out=least)
    rows = _mixed(least).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _PLACE[k] + rows[:, k])
    return key


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, at, fp, sig, n, keys)``: hash of the text, SimHash, hash and size of the shingle set, its band keys; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            fp, sig, sizes, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py(), words)
                fp.append(simhash.fingerprint_of(text.as_py()))
                sig.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes).view(np.int64) if len(hashes) else [])
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, sig)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["id", "at", "fp", "sig", "n", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("at"), text_col).mapInArrow(run, f"id {kind}, at bigint, fp bigint, sig bigint, n int, keys array<bigint>")


def _sets(docs: DataFrame, rows: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(sig, hashes)``: the whole shingle set of each ``needed`` sig, from one document that has it. Texts don't move while these documents are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["sig", "hashes"])

    one = rows.groupBy("sig").agg(F.min(F.struct("id", "at")).alias("d")).join(needed, "sig").select("sig", F.col("d.id").alias("id"), F.col("d.at").alias("at"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_at"), F.col(text_col).alias("text"))
    texts = texts.join(bounded(recovery_point(one), MOST_KEYS), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_at") == F.col("at"))).select("sig", "text")
    return texts.mapInArrow(run, "sig bigint, hashes array<bigint>").groupBy("sig").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(u, v)`` whose sets have a Jaccard similarity of 0.8 or more."""
    a, b = (sets.select(F.col("sig").alias(k), F.col("hashes").alias(f"{k}_set")) for k in "uv")
    return pairs.join(a, "u").join(b, "v").where(9 * F.size(F.array_intersect("u_set", "v_set")) >= 4 * (F.size("u_set") + F.size("v_set"))).select("u", "v")


def _fits(u: str, v: str) -> Column:
    """Whether sets of these sizes, with these numbers of shared shingles, can be similar."""
    return 9 * F.least(f"{u}.c", f"{v}.c") >= 4 * (F.col(f"{u}.n") + F.col(f"{v}.n"))


def _shared_part(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """The members ``crowd(key, v)`` that can be similar to any other, with the number of their shingles that other sets of the crowds hold."""
    held = sets.join(crowd.select(F.col("v.sig").alias("sig")).distinct(), "sig", "left_semi").select("sig", F.explode("hashes").alias("hash"))
    alone = held.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min("sig").alias("sig")).where("times = 1").groupBy("sig").agg(F.count(F.lit(1)).alias("alone"))
    counted = crowd.select("key", "v.sig", "v.n").join(alone, "sig", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0)))
    return counted.where("5 * c >= 4 * n").select("key", F.struct("sig", "n", "c").alias("v"))


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(sig, fp, root)`` with the roots of what ``edges(u, v)``, between roots, connects."""
    found = connected_components(edges).withColumnRenamed("root", "top")
    return recovery_point(nodes.join(found, nodes["root"] == found["node"], "left").select("sig", "fp", F.coalesce("top", "root").alias("root")))


def _between_roots(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.groupBy(F.col("sig").alias(k)).agg(F.min("root").alias(f"{k}_root")) for k in "uv")
    return pairs.join(a, "u").join(b, "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))


def _cells(crowd: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, x, y, sig, root, c)``: members of each key of ``crowd(key, v)`` that holds several groups, in pairs of blocks. Two members of different groups meet in one pair of a key they share."""
    placed = recovery_point(crowd.join(nodes.select("sig", "root").distinct(), F.col("v.sig") == F.col("sig")).select("key", "sig", "root", "v.n", "v.c"))
    parts = placed.groupBy("key", "root").agg(F.sum("n").alias("n"))
    keys = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("whole"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    keys = recovery_point(keys.select("key", "top", F.ceil((F.col("whole") - F.col("most")) / DEALT).alias("others"), F.ceil(F.col("most") / DEALT).alias("tops")))
    of_top, spread = F.col("root") == F.col("top"), F.xxhash64("sig")
    own = F.when(of_top, F.col("others") + F.pmod(spread, "tops")).otherwise(F.pmod(spread, "others"))
    last = F.when(of_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    dealt = placed.join(bounded(keys, MOST_KEYS), "key").select("key", "sig", "root", "c", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sig", "root", "c")


def _joining(cell: pa.Table) -> pa.Table:
    """``(u, v)``: roots of a pair of blocks ``(root, c, hashes)`` that links join, as few as connect the same groups."""
    sets, c = cell.column("hashes").combine_chunks(), cell.column("c").to_numpy()
    _, group, size = np.unique(cell.column("root").to_numpy(), return_inverse=True, return_counts=True)
    order = np.lexsort((group, size[group]))
    sets, c, group, root = sets.take(pa.array(order)), c[order], group[order], cell.column("root").to_numpy()[order]
    starts, n = np.asarray(sets.offsets[:-1]) - sets.offsets[0].as_py(), np.asarray(sets.value_lengths())
    distinct, ids = np.unique(np.asarray(sets.flatten()), return_inverse=True)
    held, found = np.zeros(len(distinct), np.int32), []
    for a in range(len(n) - 1):
        after = slice(a + 1, None)
        if not (maybe := (group[after] != group[a]) & (9 * np.minimum(c[after], c[a]) >= 4 * (n[after] + n[a]))).any():
            continue
        own = ids[starts[a] : starts[a] + n[a]]
        held[own] = 1
        both = np.add.reduceat(held[ids[starts[a + 1] :]], starts[after] - starts[a + 1])
        held[own] = 0
        for b in a + 1 + np.flatnonzero(maybe & (9 * both >= 4 * (n[after] + n[a]))):
            if group[b] != group[a]:
                found.append((root[a], root[b]))
                group[group == group[b]] = group[a]
    return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate("uv")})


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, at, root)``: one row per row of ``docs``."""
    rows = recovery_point(_sketches(docs, id_col, text_col))
    member = F.struct("sig", "n", F.col("n").cast("bigint").alias("c")).alias("v")
    keyed = rows.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), member)
    shared = recovery_point(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    members = recovery_point(keyed.join(bounded(shared, MOST_KEYS), "key"))
    sets = recovery_point(_sets(docs, rows, members.select("v.sig").distinct(), id_col, text_col))
    pair = F.col("u.sig").alias("u"), F.col("v.sig").alias("v")
    few = members.where(F.col("many") <= CROWD).groupBy("key").agg(F.collect_list("v").alias("all"))
    few = few.select("all", F.explode("all").alias("u")).select("u", F.explode(F.expr("filter(all, x -> x.sig > u.sig)")).alias("v"))
    crowd = recovery_point(_shared_part(members.where(F.col("many") > CROWD), sets))
    hubs = crowd.groupBy("key").agg(F.max_by("v", F.struct(F.col("v.c") / F.col("v.n"), "v.sig")).alias("u"), F.count(F.lit(1)).alias("many")).where("many > 1")
    around = crowd.join(hubs, "key").where("u.sig <> v.sig")
    first = few.unionByName(around.select("u", "v")).where(_fits("u", "v")).select(*pair).distinct()

    nodes = rows.select("sig", "fp", F.col("fp").alias("root")).distinct()
    same = rows.select("sig", F.col("fp").alias("u")).distinct().join(rows.groupBy("sig").agg(F.min("fp").alias("v")), "sig").select("u", "v")
    # Each kind of links has a plan of its own: one plan of all takes much of the driver's memory, whatever the rows.
    alike, near = recovery_point(_verified(first, sets)), recovery_point(simhash.links(nodes.select("fp").distinct()))
    nodes = _rooted(nodes, near.unionByName(same).unionByName(_between_roots(alike, nodes)))

    met = _cells(crowd, nodes).join(sets, "sig").select("key", "x", "y", "root", "c", "hashes")
    joined = recovery_point(met.groupBy("key", "x", "y").applyInArrow(_joining, "u bigint, v bigint").distinct())
    nodes = nodes if joined.isEmpty() else _rooted(nodes, joined)
    return join_hot(rows.select("id", "at", "sig"), nodes.select("sig", "root").distinct(), "sig").select("id", "at", "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id_col, at, component_id)``; ``at`` is the xxhash64 of the text.

    ``component_id`` is the smallest id reachable over links, its own included (null if the component has none). Null and empty texts are
    copies of each other; long texts are compared whole; repeated rows each get their row; other columns aren't read; an empty table gives an empty result.
    """
    members = recovery_point(_members(docs, id_col, text_col))
    lowest = members.groupBy("root").agg(F.min("id").alias("component_id"))
    return join_hot(members, lowest, "root").select(F.col("id").alias(id_col), "at", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, as ``one_of_each`` says: that of the smallest id; exact repeats and copies with a null id go too."""
    members = _members(docs, id_col, text_col).select("id", F.col("at").alias("tie"), "root")
    return one_of_each(docs, recovery_point(members), id_col, text_col)
