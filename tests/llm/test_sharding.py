import hashlib
import zlib

import numpy as np
import pytest
from brute import HAS_TABLES, SF, rows_of, spark_hash

from textloom.llm import queries, sharding

MASK = (1 << 64) - 1


def scrambled(x, key):
    x = (x + key) * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 29) * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def feistel(number, n, seed):
    """One number through the rounds, again until it is below n."""
    bits = max(n - 1, 1).bit_length()
    half = (bits + 1) // 2
    keys = [scrambled(r, (seed * 0x10001 + r) & MASK) for r in range(1, 7)]
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for key in keys:
            left, right = right, left ^ scrambled(right, key) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


def test_permutation_is_one_to_one_and_invertible():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        out = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(out) == list(range(n))
        assert (sharding.permute(out, n, seed=3, inverse=True) == np.arange(n)).all()
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).any()


def test_places_compute_both_ways():
    for row in (0, 5, 99):
        assert sharding.row_at(*sharding.place_of(row, 100, 16, 4), 100, 16, 4) == row


def test_shards_are_even_gapless_and_repeatable(spark, make_docs):
    rows = [(i, f"text {i % 50}") for i in range(500)] + [(None, None), (None, "x"), (3, "text 3"), (7, "")]
    docs = make_docs(rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "BUCKET")
    out = sharding.shuffle_into_shards(docs, 16, seed=1)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    got = out.collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard_"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(7), 16, seed=1).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard_"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_few_rows(spark, make_docs):
    assert sharding.shuffle_into_shards(make_docs([]), 4).count() == 0
    only = sharding.shuffle_into_shards(make_docs([(1, "a")]), 4).first()
    assert (only["slot"], 0 <= only["shard"] < 4) == (0, True)


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_query_against_brute_force(spark):
    rows = []
    for doc, text in rows_of(spark, "documents", "doc_id", "text"):
        data = (text or "").encode()
        md5 = hashlib.md5(data).digest()
        h = spark_hash(doc, md5)
        rows.append((h % sharding.LEAST_BUCKETS, h, doc, md5, len(data) + 1, zlib.crc32(data)))
    rows.sort()
    expected = []
    for number, (_, _, doc, _, size, crc) in enumerate(rows):
        place = feistel(number, len(rows), 0)
        expected.append((doc, size, crc, "rows", place % 16, place // 16, None))
    got = queries.op8_shards(spark, SF).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
