"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the words in a short span and ignore the others, so a seed still matches where
ignored words were substituted. An overlap is confirmed if a window of ``window`` aligned words has at least ``share`` of them equal.
The masks are computed so that none is missed: for each window length and each way to place the substitutions
that the share allows, some mask lies on equal words only (``covering``). So results don't depend on the masks.

Search. All masks share a core, the short mask of ``CORES``. A document's cores are joined with those of the benchmark, the
few places that meet one are given all masks' seeds, and these are joined with the benchmark's seeds. What is joined is broadcast in
blocks of a bounded number of benchmark words; each block is searched in all documents. Hits are reduced
to diagonals (document place minus item place), and each diagonal is verified word by word around its hits.

Lengths. Items of 13 words and more need 10 of 13 words equal; items of 8 to 12 words are one window themselves; shorter ones
must stand word for word, as three of four equal words say nothing. Items under ``SHORTEST`` words would flag any document and
are left out. Items of over ``PIECE`` words are searched in pieces that overlap by a window less one word.

DataFrame functions only. Texts don't move while there are at most ``MOST_KEYS`` documents with a hit.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import let
from textloom.llm._common import bounded, recovery_point, without
from textloom.llm.licenses import spaced

WINDOW, SHARE = 13, 0.75
#: Words that a mask selects, and the cores, of which later ones are used only if the first don't cover all cases.
WEIGHT, CORES = 5, ("1101", "111", "11", "1")
#: Items of fewer words must be met whole; those under SHORTEST aren't searched.
EXACT_BELOW, SHORTEST = 8, 3
#: Benchmark words broadcast at a time, words of a piece, and rows of keys or hits that are broadcast.
BLOCK_WORDS, PIECE, MOST_KEYS = 100_000, 1000, 200_000


def word_hashes(text: str) -> Column:
    """Hashes of a text's words (letters a-z without case, digits, all code points from 128 on)."""
    words = F.filter(F.split(F.trim(spaced(F.col(text))), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def substitutions(n: int, window: int = WINDOW, share: float = SHARE) -> int:
    """Words of a window that may differ, for an item of n words."""
    return 0 if n < EXACT_BELOW else int(min(n, window) * (1 - share) + 1e-9)


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, bit in enumerate(mask) if bit == "1")


@cache
def covering(n: int, m: int) -> tuple[tuple[str, str, int], ...]:
    """Masks as (mask, core, the core's place in the mask): however m of n words are substituted, one of them lies on equal words.

    Chosen greedily, the mask that covers most open cases first. A window much longer than WINDOW is halved and so on: one part has its share of the substitutions at most.
    """
    parts = -(-n // (WINDOW + 3))
    n, m = n // parts, m // parts
    if not 0 <= m < n:
        raise ValueError("a window needs an equal word")
    cases = [frozenset(c) for c in combinations(range(n), m)]
    covered: dict[tuple[str, str, int], int] = {}
    for number, core in enumerate(CORES):
        for place in range(n - len(core) + 1):
            own = {place + o for o in _offsets(core)}
            others = [x for x in range(n) if x not in own]
            for extra in combinations(others, min(max(0, WEIGHT - len(own)), max(0, n - m - len(own)))):
                at = sorted(own | set(extra))
                if at[0] == 0:
                    mask = "".join("1" if i in at else "0" for i in range(at[-1] + 1))
                    free = [{x + shift for x in at} for shift in range(n - at[-1])]
                    covered[mask, core, place] = sum(1 << k for k, case in enumerate(cases) if any(not f & case for f in free))
        picked, open_ = [], (1 << len(cases)) - 1
        while open_:
            best = max(sorted(covered), key=lambda x: (covered[x] & open_).bit_count(), default=None)
            if best is None or not covered[best] & open_:
                break
            picked.append(best)
            open_ &= ~covered[best]
        if not open_:
            return tuple(picked)
    raise ValueError("no masks found")


def _hash(tag: str, array: str, at: str, offsets: tuple[int, ...]) -> str:
    return f"xxhash64('{tag}', " + ", ".join(f"get({array}, {at} + {o})" for o in offsets) + ")"


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """``(no, item_id)`` and ``(no, from, item, n, w)``: equal items are one number; long ones are cut."""
    step = PIECE - window + 1
    items = recovery_point(benchmark.select(F.col(item_col).alias("item_id"), word_hashes(text_col).alias("all")).where(F.size("all") >= SHORTEST).withColumn("no", F.xxhash64("all")).distinct())
    cut = items.groupBy("no").agg(F.first("all").alias("all")).select("no", "all", F.explode(F.expr(f"sequence(0, greatest(0, size(all) - {window}), {step})")).alias("from"))
    cut = cut.select("no", "from", F.slice("all", F.col("from") + 1, F.lit(PIECE)).alias("item"))
    sized = cut.select("no", "from", "item", F.size("item").alias("n")).withColumn("w", F.least(F.col("n"), F.lit(window)))
    return items.select("no", "item_id").distinct(), recovery_point(sized)


def _blocks(pieces: DataFrame) -> list[DataFrame]:
    """The pieces dealt into blocks of at most 2 * BLOCK_WORDS words."""
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("no", "from"), F.lit(blocks)))
        if (dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= 2 * BLOCK_WORDS:
            return [dealt.where(F.col("block") == b).drop("block") for b in range(blocks)]
        blocks *= 2


def _hits(hashed: DataFrame, pieces: DataFrame, masks: dict[int, tuple[tuple[str, str, int], ...]]) -> DataFrame:
    """``(id, tie, no, from, diag, low, high)``: diagonals with a hit, and the hits' first and last place in the piece."""
    numbered = sorted({m for some in masks.values() for m in some})
    out = None
    for core in sorted({c for _, c, _ in numbered}):
        used = [x for x in numbered if x[1] == core]
        met = F.expr(f"transform(words, (x, i) -> {_hash(core, 'words', 'i', _offsets(core))})")
        known = F.explode(F.expr(f"transform(sequence(0, n - 1), i -> {_hash(core, 'item', 'i', _offsets(core))})"))
        cores = F.broadcast(pieces.select(known.alias("core")).distinct())
        at = hashed.select("id", "tie", "words", F.posexplode(met).alias("at", "core")).join(cores, "core", "left_semi")
        asked = [F.expr(f"struct(at - {p} as start, {_hash(mask, 'words', f'at - {p}', _offsets(mask))} as seed)") for mask, _, p in used]
        asked = at.select("id", "tie", F.explode(F.array(*asked)).alias("s")).select("id", "tie", F.col("s.start").alias("start"), F.col("s.seed").alias("seed"))
        given = None
        for mask, _, _ in used:
            lengths = [n for n, some in masks.items() if any(x[0] == mask and x[1] == core for x in some)]
            each = pieces.where(F.col("w").isin(lengths) & (F.col("n") >= len(mask)))
            each = each.select("no", "from", F.posexplode(F.expr(f"transform(sequence(0, n - {len(mask)}), i -> {_hash(mask, 'item', 'i', _offsets(mask))})")).alias("place", "seed"))
            given = each if given is None else given.unionByName(each)
        found = asked.join(F.broadcast(given), "seed").select("id", "tie", "no", "from", (F.col("start") - F.col("place")).alias("diag"), "place")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("id", "tie", "no", "from", "diag").agg(F.min("place").alias("low"), F.max("place").alias("high"))


def _confirmed(share: float) -> Column:
    """Windows around a diagonal's hits that reach the share: an array of (start in the piece, equal words). Columns: words, item, n, w, diag, low, high."""
    need = f"if(n < {EXACT_BELOW}, w, ceil({share}D * w - 1e-9D))"
    first, last = "greatest(0, low - w + 1)", "least(n - w, high)"
    equal = F.expr(f"transform(sequence({first}, {last} + w - 1), j -> if(coalesce(get(words, diag + j) = get(item, j), false), 1, 0))")
    rated = lambda e: F.transform(F.expr(f"sequence({first}, {last})"), lambda s, i: F.struct(s.alias("start"), F.aggregate(F.slice(e, i + 1, F.col("w")), F.lit(0), lambda a, x: a + x).alias("equal")))
    return let(let(equal, rated), lambda all_: F.filter(all_, lambda r: r["equal"] >= F.expr(need)))


def _spans(docs: DataFrame, pieces: DataFrame, id_col: str, text_col: str, window: int, share: float) -> DataFrame:
    """Confirmed overlaps: ``(id, tie, no, first, last, equal_share)``, one row for each document and different item."""
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    words = hashed.select("id", "tie", word_hashes("text").alias("words"))
    lengths = [r[0] for r in pieces.select("w").distinct().collect()]
    masks = {n: covering(n, substitutions(n, window, share)) for n in lengths}
    kind = "struct<id: {}, tie: bigint, no: bigint, from: int, diag: int, low: int, high: int>".format(docs.schema[id_col].dataType.simpleString())
    if not lengths:
        empty = hashed.limit(0).select(F.lit(None).cast(kind).alias("x"))
        return empty.select("x.id", "x.tie", "x.no", F.col("x.diag").alias("first"), F.col("x.diag").alias("last"), F.lit(0.0).alias("equal_share"))
    found = None
    for block in _blocks(pieces):
        one = recovery_point(_hits(words, block, masks))
        found = one if found is None else found.unionByName(one)
    keys = bounded(recovery_point(found.select("id", "tie").distinct()), MOST_KEYS)
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))
    held = hashed.alias("d").join(keys.alias("k"), same("d", "k"), "left_semi").distinct().select("id", "tie", word_hashes("text").alias("words"))
    placed = held.alias("d").join(bounded(found, MOST_KEYS).alias("f"), same("d", "f")).select("d.id", "d.tie", "words", "no", "from", "diag", "low", "high")
    rated = placed.join(bounded(pieces, MOST_KEYS // PIECE), ["no", "from"]).withColumn("ok", _confirmed(share)).where(F.size("ok") > 0)
    ends = rated.select("id", "tie", "no", F.greatest(F.col("diag") + F.col("ok")[0]["start"], F.lit(0)).alias("first"), F.least(F.col("diag") + F.element_at("ok", -1)["start"] + F.col("w"), F.size("words")).alias("stop"), (F.array_max("ok.equal") / F.col("w")).alias("equal"))
    return ends.groupBy("id", "tie", "no").agg(F.min("first").alias("first"), (F.max("stop") - 1).alias("last"), F.max("equal").alias("equal_share"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Confirmed overlaps: one row for each document (id and text's hash ``tie``) and item.

    Columns: id, tie, item (the ids' own types), first_word and last_word (of the document, from 0, over all confirmed windows), equal_share (of the
    best window). Null and empty texts have no overlap; null ids are reported as such; rows equal in id and text give one result, and items equal
    in words one each; long texts are searched whole; an empty table on either side gives an empty result. Other columns aren't read.
    """
    items, pieces = _pieces(benchmark, item_col, item_text, window)
    found = _spans(docs, pieces, id_col, text_col, window, share)
    return found.join(items, "no").groupBy("id", "tie", F.col("item_id").alias("item")).agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("equal_share").alias("equal_share"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``overlaps`` by document id and item id: (id_col, item_id, first_word, last_word, equal_share)."""
    found = overlaps(docs, benchmark, id_col, text_col, **options)
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias("item_id")).agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("equal_share").alias("equal_share"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without a confirmed overlap, in all their columns; a row goes by its id and its own text."""
    _, pieces = _pieces(benchmark, item_col, item_text, window)
    bad = _spans(docs, pieces, id_col, text_col, window, share).select("id", "tie").distinct()
    return without(docs, recovery_point(bad), id_col, text_col)
