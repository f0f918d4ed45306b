from hashlib import sha256

import pytest
from brute import HAS_TABLES, SF, rows_of, spark_hash
from pyspark.sql import functions as F

from textloom.llm import queries, syncmers

WORDS = [f"w{i * i % 61}" for i in range(200)]
ROWS = [(4, " ".join(WORDS)), (1, " ".join(WORDS[:90])), (2, None), (3, ""), (7, "a"), (8, "A"), (9, "é" * 50), (12, " ".join(WORDS)), (None, "null id text"), (15, "x y " * 300), (20, "long text of words " * 20_000)]


def brute(text, k=syncmers.K, s=syncmers.S):
    """Anchors as (hash, word)."""
    lower = (text or "").lower()
    for white in "\t\n\x0b\x0c\r":
        lower = lower.replace(white, " ")
    words = [syncmers.START] * (k - 1) + [w for w in lower.split(" ") if w] + [syncmers.STOP] * (k - 1)
    inner = [spark_hash(*words[i : i + s]) for i in range(len(words) - s + 1)]
    out = []
    for i in range(len(words) - k + 1):
        span = inner[i : i + k - s + 1]
        if min(span[0], span[-1]) <= min(span[1:-1]):
            out.append((spark_hash(*span[::s], span[-1]) >> 32, i - (k - 1)))
    return out


def brute_links(found):
    return {spark_hash(a[0], b[0], b[1] - a[1]) >> 32 if b else spark_hash(a[0]) >> 32 for a, b in zip(found, [*found[1:], None], strict=True)}


def brute_likeness(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def brute_written(found):
    return "".join(f"{a[0] & 0xFFFFFFFF:08x}{b[1] - a[1] if b else 0:x}" for a, b in zip(found, [*found[1:], None], strict=True))


def brute_rows(rows):
    """Per row in ascending order: id, n_chars, hash of the edited text, both fingerprints, both likenesses."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, other, following = brute(text), brute(edited), brute(after)
        yield doc, len(text), sha256(edited.encode()).hexdigest(), brute_written(own), brute_written(other), brute_likeness(brute_links(own), brute_links(other)), brute_likeness(brute_links(own), brute_links(following))


def test_anchors_are_closed_syncmers(spark):
    df = syncmers.anchors("text", spark.createDataFrame(ROWS, "doc_id bigint, text string"), "found")
    for r in df.select("text", syncmers.positions("found").alias("places"), syncmers.links("found").alias("links"), syncmers.written("found").alias("said")).collect():
        assert [tuple(a) for a in r["places"]] == brute(r["text"]) != []
        assert set(r["links"]) == brute_links(brute(r["text"])) and r["said"] == brute_written(brute(r["text"]))


def test_a_shared_passage_matches_by_position(spark):
    middle = " ".join(f"m{i}" for i in range(100))
    texts = ["one two three " + middle + " end", "completely other start of it " + middle + " and tail words", " ".join(f"m{i}" for i in reversed(range(100)))]
    df = syncmers.anchors("text", spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "found")
    a, b, c = (set(r["links"]) for r in df.select("i", syncmers.links("found").alias("links")).orderBy("i").collect())
    assert len(a & b) > 20 and not a & c


def test_edited_and_next(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("kid", F.lit(1)).withColumn("TIE", F.lit(2))
    found = syncmers.with_edited(df).withColumns({"a": syncmers.links("prints"), "b": syncmers.links("edited_prints")})
    got = found.select("doc_id", "n_chars", F.sha2("edited", 256), syncmers.written("prints"), syncmers.written("edited_prints"), syncmers.likeness("a", "b"), syncmers.likeness("a", "next_links")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_rows(ROWS), key=repr)


def test_repeated_rows_and_small_tables(spark):
    schema = "doc_id bigint, text string"
    assert syncmers.with_edited(spark.createDataFrame([], schema)).count() == 0
    assert [r["edited"] for r in syncmers.with_edited(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()] == ["abcdefab"]
    assert [r["edited"] for r in syncmers.with_edited(spark.createDataFrame([(1, "abcdefgh"), (1, "abcdefgh"), (2, "12345678")], schema)).orderBy("doc_id").collect()] == ["abcdef12", "abcdef12", "123456ab"]


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_query_against_brute_force(spark):
    got = queries.op6_syncmers(spark, SF).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got)) == sorted(brute_rows(rows_of(spark, "documents", "doc_id", "text")))
