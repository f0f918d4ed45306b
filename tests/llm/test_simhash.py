import random

import numpy as np
import pytest
import xxhash
from brute import HAS_TABLES, SF, rows_of

from textloom.llm import _common, components, queries, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) * 2 > len(grams):
            out |= 1 << bit
    return out


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_counts_bits_over_half():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c d e f g a b c", "é ü\x0bß x y z \x1f w"):
        assert simhash.fingerprint_of(text) == slow_print(text)
    long = " ".join(str(i % 977) for i in range(simhash.BLOCK + 50))
    assert simhash.fingerprint_of(long) == slow_print(long)


def check_links(spark, values, distance, crowd):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), distance, crowd).collect()
    near = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
    got = {(min(r), max(r)) for r in map(tuple, found)}
    assert got <= {(min(p), max(p)) for p in near}
    assert roots(got, signed) == roots(near, signed)
    return got, near


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    for distance in (1, 2, 3):
        got, near = check_links(spark, sorted(values), distance, 64)
        assert len(got) == len({(min(p), max(p)) for p in near})


def test_crowded_keys_lose_no_link_and_make_no_square(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 4))) for _ in range(400)}
    for distance in (2, 3):
        got, near = check_links(spark, sorted(values), distance, 8)
        assert len(got) < len(near)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    expected = {n: r for n, r in roots(edges, {x for e in edges for x in e}).items()}
    assert {n: found.get(n, n) for n in expected} == expected
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_whole_table(spark, make_docs):
    base = "the quick brown fox jumps over the lazy dog while seventeen green birds sing quietly in old trees"
    rows = [(5, base), (9, base.upper()), (2, "other words stand here alone"), (7, None), (3, ""), (8, "  "), (None, base), (2, "other words stand here alone"), (11, base + " x")]
    docs = make_docs(rows).withColumnRenamed("lang", "component_id_")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    prints = {r: slow_print(r[1]) for r in rows}
    pairs = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if bin(prints[rows[a]] ^ prints[rows[b]]).count("1") <= 2]
    root = roots(pairs, range(len(rows)))
    expected = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        expected.append((r[0], int(np.uint64(prints[r]).astype(np.int64)), min(ids)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def one_of_each(rows, root):
    """The rows that stay: of each group the one of the smallest id (null last), then of the smallest text hash, once."""
    stay = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, (x := xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) - (x >> 63 << 64) if r[1] is not None else 42)
        if root[i] not in stay or key < stay[root[i]][0]:
            stay[root[i]] = (key, r[:2])
    return sorted((r for _, r in stay.values()), key=repr)


def test_deduplicate_goes_by_id_and_text(spark, make_docs, monkeypatch):
    a, b, other = (" ".join(random.Random(n).choice("abcdefgh") * 3 for _ in range(40)) for n in range(3))
    rows = [(2, a), (5, a.upper()), (5, other), (7, b), (7, b), (None, a), (None, b), (8, None), (8, ""), (8, ""), (None, "only here " * 9), (None, "only here " * 9)]
    rows += [(i, a) for i in range(100, 400)]
    docs = make_docs(rows).withColumnRenamed("lang", "root").withColumnRenamed("source", "tie")
    prints = [slow_print(r[1]) for r in rows]
    expected = one_of_each(rows, roots([(i, prints.index(p)) for i, p in enumerate(prints)], range(len(rows))))
    assert len(expected) == 5
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == expected
    monkeypatch.setattr(_common, "MOST_KEYS", 0)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect()), key=repr) == expected


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.deduplicate(make_docs([])).count() == 0


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_query_against_brute_force(spark):
    rows = rows_of(spark, "documents", "doc_id", "text")
    prints = {i: slow_print(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = roots(near, prints)
    expected = sorted((i, f"{prints[i]:016x}", root[i]) for i in prints)
    got = sorted(tuple(r) for r in queries.op3_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert got == expected and near
