import random

import numpy as np
import pytest

from textloom.llm import components, near_copies, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def kept_by_brute_force(rows):
    sets, prints = [shingle_set(t) for _, t in rows], [simhash.fingerprint_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and (similar(sets[a], sets[b]) or bin(prints[a] ^ prints[b]).count("1") <= 2):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(i for (i, _), r in zip(rows, root, strict=True) if least[r] == i)


def check_kept(rows, kept):
    """No two that stay are linked; each that goes is connected to one that stays."""
    sets, prints = {i: shingle_set(t) for i, t in rows}, {i: simhash.fingerprint_of(t) for i, t in rows}
    linked = lambda a, b: similar(sets[a], sets[b]) or bin(prints[a] ^ prints[b]).count("1") <= 2
    kept = set(kept)
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    reached, new = set(kept), set(kept)
    while new:
        new = {i for i, _ in rows if i not in reached and any(linked(i, j) for j in new)}
        reached |= new
    assert reached == {i for i, _ in rows}


def planted(rng, copies, crowd):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    edit = lambda words, times: [word() if i in set(rng.sample(range(len(words)), times)) else w for i, w in enumerate(words)]
    out = [text(rng.randint(1, 300)) for _ in range(40)]
    for _ in range(copies):
        base = text(rng.randint(120, 300))
        out += [base, edit(base, rng.randint(1, 4))]
    base = text(250)
    out += [base] + [edit(base, rng.randint(1, 6)) for _ in range(crowd)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_planted_near_copies_are_all_found(make_docs):
    rows = planted(random.Random(3), 60, 40)
    kept = sorted(r["doc_id"] for r in near_copies.deduplicate(make_docs(rows)).collect())
    check_kept(rows, kept)
    assert len(kept) + 40 < simhash.deduplicate(make_docs(rows)).count()


def test_crowd_around_a_base(make_docs, monkeypatch):
    # One text, copies with few and with many edits, and texts that only share a passage with it.
    monkeypatch.setattr(near_copies, "CROWD", 3)
    some = random.Random(6)
    word = lambda: "".join(some.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [base] + [[word() if i in set(some.sample(range(150), edits)) else w for i, w in enumerate(base)] for edits in range(1, 9) for _ in range(8)]
    texts += [[word() for _ in range(some.randint(20, 60))] + base[30:90] + [word() for _ in range(40)] for _ in range(40)]
    some.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = [r["doc_id"] for r in near_copies.deduplicate(make_docs(rows)).collect()]
    check_kept(rows, kept)
    assert len(kept) < 40 + 65 - 20


def test_crowd_of_texts_that_are_not_copies(make_docs, monkeypatch):
    # All texts meet in every key, and few of them are similar.
    monkeypatch.setattr(near_copies, "band_keys", lambda h: np.arange(near_copies.BANDS, dtype=np.uint64))
    rows = planted(random.Random(4), 8, 6)
    check_kept(rows, [r["doc_id"] for r in near_copies.deduplicate(make_docs(rows)).collect()])


def test_ids_texts_and_empty_tables(make_docs):
    base = "the quick brown fox jumps over the lazy dog while seventeen green birds sing quietly in old trees"
    rows = [(5, base), (9, base.upper()), (9, "other words stand here alone"), (7, None), (3, ""), (None, base), (11, "Two words"), (12, "two  WORDS")]
    docs = make_docs(rows).withColumnRenamed("lang", "component_id_")
    out = near_copies.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[6]]))
    twice = make_docs([*rows, *rows, (9, "a third text of this id")])
    assert sorted(repr((r["doc_id"], r["text"])) for r in near_copies.deduplicate(twice).collect()) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[6], (9, "a third text of this id")]))
    assert near_copies.deduplicate(make_docs([])).count() == 0


@pytest.mark.parametrize("dealt", [1 << 17, 500])
def test_crowd_in_chains(make_docs, monkeypatch, dealt):
    # In one crowd, chains whose links don't touch the best center or another group's, and texts that share much with all and are similar to none.
    monkeypatch.setattr(near_copies, "band_keys", lambda h: np.arange(near_copies.BANDS, dtype=np.uint64))
    monkeypatch.setattr(near_copies, "DEALT", dealt, raising=False)
    some = random.Random(8)
    word = lambda: "".join(some.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [base]
    for _ in range(3):
        now, places = list(base), some.sample(range(30), 12)
        for at in places:
            now = [word() if i == 5 * at else w for i, w in enumerate(now)]
            texts.append(now)
    texts += [base[50:] + base[:n] + [word()] for n in range(0, 20, 2)]
    some.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(make_docs(rows)).collect()) == kept_by_brute_force(rows)
    groups = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()}
    assert sorted(set(groups.values())) == kept_by_brute_force(rows)


def test_plans_stay_small(make_docs, monkeypatch):
    # The driver plans anew after each exchange and keeps every plan: a plan of all links at once took it over its memory on a small table.
    found, real = [], near_copies.recovery_point
    monkeypatch.setattr(near_copies, "recovery_point", lambda df: found.append(df) or real(df))
    monkeypatch.setattr(components, "recovery_point", lambda df: found.append(df) or real(df))
    rows = planted(random.Random(5), 12, 20)
    check_kept(rows, [r["doc_id"] for r in near_copies.deduplicate(make_docs(rows)).collect()])
    exchanges = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") for df in found]
    assert len(exchanges) > 10 and max(exchanges) <= 12, exchanges


@pytest.mark.parametrize("edges", [1, 8, 20_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "EDGES", edges)
    some, least = random.Random(9), {}
    pairs = [tuple(some.choice(range(-40, 40)) for _ in "uv") for _ in range(45)] + [(1 << 62, -(1 << 62)), (7, 7)]
    for u, v in pairs:
        least.setdefault(u, u), least.setdefault(v, v)
        low, high = sorted((least[u], least[v]))
        least = {x: low if r == high else r for x, r in least.items()}
    out = components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint"))
    assert out.dtypes == [("node", "bigint"), ("root", "bigint")]
    assert sorted(map(tuple, out.collect())) == sorted((x, r) for x, r in least.items() if x != r)
