"""Document fingerprints of closed syncmers.

A text is a sequence of words (lower-cased, cut at white space), with k - 1 marks for its start and end around it, so that even the shortest
text has anchors. A k-mer is k consecutive words; its inner substrings
are its runs of s words, each with a hash. A k-mer is an anchor if its least inner hash is the first or the last one. That
depends on the k-mer alone, so texts that share a passage share the anchors inside it, wherever it stands, and any
k - s + 1 neighbouring k-mers hold an anchor. With the default 7 and 3 two in five k-mers are anchors.

The fingerprint lists the anchors in text order, each with a 32-bit hash and its place. Fingerprints are matched by position: a link is an anchor with
its next one and their distance in words, so links are shared where the same anchors stand in the same order and at the same distances, at whatever
place of the texts. Likeness: twice the number of distinct shared links over the sum of distinct links (1 for equal texts).

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._common import free_name, recovery_point, shuffle_width

K, S = 7, 3


#: Marks of the start and the end; they hold white space, as no word does.
START, STOP = "< ", "> "


def words_of(text: Column, k: int = K) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.concat(F.array(*[F.lit(START)] * (k - 1)), words, F.array(*[F.lit(STOP)] * (k - 1)))


def inner_hashes(words: Column, s: int = S) -> Column:
    """Hash of each run of s words; those of the last s - 1 words cover what is left."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, s))))


def anchors(text: str, df: DataFrame, name: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the anchors of column ``text`` appended, in text order: an array of longs, hash in the upper half, place (from 0, the marks' words counted) in the lower."""
    words, inner = (free_name(df, f"{name}_{x}") for x in ("words", "inner"))
    span = k - s  # the last inner substring of the k-mer at i starts at i + span

    def mark(x: Column, i: Column) -> Column:
        at = [x, *(F.get(F.col(inner), i + j) for j in range(1, span + 1))]
        least = F.least(*at[1:-1]) if span > 2 else at[1] if span == 2 else F.lit((1 << 63) - 1)
        return F.when((i <= F.size(inner) - k) & (F.least(at[0], at[-1]) <= least), F.shiftleft(F.shiftright(F.xxhash64(*at[::s], at[-1]), 32), 32) + i)

    out = df.withColumn(words, words_of(F.col(text), k)).withColumn(inner, inner_hashes(F.col(words), s))
    return out.withColumn(name, F.filter(F.transform(inner, mark), lambda h: h.isNotNull())).drop(words, inner)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(0xFFFFFFFF)


def positions(found: str, k: int = K) -> Column:
    """Anchors as (hash, word): the number of the word at which each starts (from 0; below it in the marks)."""
    return F.transform(found, lambda x: F.struct(_hash(x).cast("int").alias("hash"), (_place(x) - (k - 1)).cast("int").alias("word")))


def links(found: str) -> Column:
    """32-bit hashes of each anchor with its next one and their distance in words; of the last anchor alone."""

    def link(x: Column, i: Column) -> Column:
        after = F.get(F.col(found), i + 1)
        return F.shiftright(F.xxhash64(_hash(x), _hash(after), _place(after) - _place(x)), 32).cast("int")

    return F.transform(found, link)


def written(found: str) -> Column:
    """Anchors as eight hex digits of their hash and one of the distance to the next (0 for the last; never above k)."""

    def one(x: Column, i: Column) -> Column:
        gap = F.coalesce(_place(F.get(F.col(found), i + 1)) - _place(x), F.lit(0))
        return F.concat(F.lpad(F.hex(_hash(x).bitwiseAND(0xFFFFFFFF)), 8, "0"), F.hex(gap))

    return F.lower(F.array_join(F.transform(found, one), ""))


def likeness(a: str, b: str) -> Column:
    """Of two arrays of links."""
    shared = F.size(F.array_intersect(a, b))
    return 2.0 * shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def in_order(keys: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``keys`` with global row numbers in the order of columns appended, and the number of rows.

    A range partitioning, sorted inside and written to the checkpoint folder; the driver gets one count for each partition.
    """
    spark = keys.sparkSession
    at, part = free_name(keys, "at"), free_name(keys, "part")
    dealt = keys.repartitionByRange(max(8, 2 * shuffle_width(spark)), *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    kept = recovery_point(dealt).withColumn(part, F.shiftright(at, 33))
    counts = sorted(kept.groupBy(part).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, f"{part} bigint, {at}_from bigint")
    placed = kept.join(F.broadcast(offsets), part).withColumn(name, F.col(f"{at}_from") + F.col(at).bitwiseAND((1 << 33) - 1))
    return placed.select(*keys.columns, name), total


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, text, edited, prints and edited_prints (anchors), next_links.

    ``edited``: the last floor(n_chars / share) code points replaced by the first as many (or all) of the next document by id. The next
    of the last is the first; a single document is its own next. Null texts are empty. Ids that occur with several texts are ordered by the texts' hash; rows equal in
    both count as one document here and each get its result. Null ids come first. Long texts are fingerprinted whole; other columns aren't read; an empty table gives an empty result.

    Texts are dealt by id once; a quarter of them, and the fingerprints, move again to the document before. Fingerprints are computed where they are
    needed rather than moved with the texts.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("kid", F.xxhash64("id")).withColumn("tie", F.xxhash64("text"))
    keys, n = in_order(src.select("id", "kid", "tie", F.length("text").alias("n")).distinct(), ["id", "tie"], "g")
    taken = keys.select("id", F.col("kid").alias("to_kid"), F.col("tie").alias("to_tie"), F.expr(f"n div {share}").cast("int").alias("most"), F.pmod(F.col("g") + 1, F.lit(max(1, n))).alias("g"))
    gives = keys.select("kid", "tie", "g").join(taken, "g").drop("g")
    full = src.select("kid", "tie", "text")  # the same columns on both sides, so that one shuffle serves both joins
    given = full.join(gives, ["kid", "tie"]).select("id", F.col("to_kid").alias("kid"), F.col("to_tie").alias("tie"), F.left("text", F.col("most")).alias("piece"), "text")
    given = anchors("text", given, "next_prints").withColumn("next_links", links("next_prints"))
    given = given.groupBy("kid", "tie").agg(F.first("id").alias("id"), F.first("piece").alias("piece"), F.first("next_links").alias("next_links"))
    met = full.join(given, ["kid", "tie"]).select("id", "text", "piece", "next_links")
    size = F.length("text")
    done = met.withColumn("n_chars", size.cast("bigint")).withColumn("edited", F.concat(F.left("text", (size - F.expr(f"n_chars div {share}")).cast("int")), F.col("piece"))).drop("piece")
    return anchors("edited", anchors("text", done, "prints"), "edited_prints").withColumnRenamed("id", id_col)
