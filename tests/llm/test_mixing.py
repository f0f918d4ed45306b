import random
from itertools import product

import pytest
from brute import HAS_TABLES, SF, rows_of, spark_hash, int32
from pyspark.sql import functions as F

from textloom.llm import mix_sources, mixing, queries


def test_fair_targets_reshare_what_is_above_the_limit():
    got = mixing.fair_targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 315)
    assert got == {"a": 20.0, "b": pytest.approx(295 / 3), "c": pytest.approx(590 / 3)}
    assert mixing.fair_targets({"a": 10, "b": 100, "c": 90}, {"a": 3, "b": 1, "c": 2}, 315) == {"a": 20.0, "b": 115.0, "c": 180.0}
    assert mixing.fair_targets({}, {}, 0) == {}
    assert mixing.fair_targets({"a": 0}, {"a": 1}, 0) == {"a": 0}


def brute_flow(offers, quotas, repeats):
    """Largest total, and least cost at it, over all integer routings of small instances."""
    arcs = [(p, s) for p in offers for s in p if s in quotas]
    best = (0, 0)
    for amounts in product(*(range(min(repeats * offers[p], quotas[s]) + 1) for p, s in arcs)):
        by_p = {p: sum(a for a, (q, _) in zip(amounts, arcs) if q == p) for p in offers}
        by_s = {s: sum(a for a, (_, t) in zip(amounts, arcs) if t == s) for s in quotas}
        if all(by_p[p] <= repeats * offers[p] for p in offers) and all(by_s[s] <= quotas[s] for s in quotas):
            cost = sum(max(0, by_p[p] - r * offers[p]) for p in offers for r in range(1, repeats))
            best = max(best, (sum(amounts), -cost))
    return best


def small_instances():
    some = random.Random(8)
    for _ in range(60):
        patterns = some.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "c"), ("a", "b", "c")], some.randint(1, 3))
        yield {p: some.randint(0, 2) for p in patterns}, {s: some.randint(0, 3) for s in "abc"[: some.randint(1, 3)]}


def test_flow_over_many_patterns():
    some = random.Random(9)
    names = [f"s{i}" for i in range(200)]
    offers = {tuple(sorted(some.sample(names, some.randint(1, 4)))): some.randint(1, 1000) for _ in range(20_000)}
    quotas = {s: some.randint(1, 300_000) for s in names}
    flow = mixing.cheapest_flow(offers, quotas)
    taken = {s: 0 for s in names}
    for p, f in flow.items():
        assert 0 <= sum(f.values()) <= 2 * offers[p] and min(f.values()) >= 0
        for s, n in f.items():
            taken[s] += n
    assert all(taken[s] <= quotas[s] for s in names)
    # largest: where a pattern could give more, all that its words could reach is full
    open_ = {p for p in offers if sum(flow[p].values()) < 2 * offers[p]}
    while True:
        full = {s for p in open_ for s in p}
        more = open_ | {p for p in offers if any(flow[p][s] > 0 for s in p if s in full)}
        if more == open_:
            break
        open_ = more
    assert all(taken[s] == quotas[s] for s in full)


def test_flow_is_largest_and_cheapest():
    for offers, quotas in (
        ({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 4, "b": 3}),
        ({("a", "b"): 3, ("b", "c"): 1}, {"a": 2, "b": 3, "c": 4}),
        ({("a",): 1}, {"a": 5}),
        ({("a", "b"): 2, ("a",): 3}, {"a": 3, "b": 4}),
        *small_instances(),
    ):
        flow = mixing.cheapest_flow(offers, quotas)
        given = {p: sum(f.values()) for p, f in flow.items()}
        taken = {s: sum(f.get(s, 0) for f in flow.values()) for s in quotas}
        assert all(given[p] <= 2 * offers[p] for p in offers) and all(taken[s] <= quotas[s] for s in quotas)
        assert (sum(given.values()), -sum(max(0, given[p] - offers[p]) for p in offers)) == brute_flow(offers, quotas, 2)


def rows():
    out = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "abc"[i % 3]) for i in range(600)]
    return out + [(1000 + i, "one two three", None) for i in range(5)] + [(2000, None, "a"), (2001, "", "b"), (None, "x y", "c"), (5, out[5][1], out[5][2]), (3000, "w " * 2_000, "a")]


def test_report_meets_targets(spark, make_docs):
    docs = make_docs(rows())
    got = mix_sources.mix_report(docs).collect()
    assert len(got) == len(rows())
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r["source_size"]] = sizes.get(r["source_size"], 0) + r["size"]
        targets[r["source_size"]] = r["target"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    held = {s: sum(len((x[1] or "").split()) for x in rows() if x[2] == s) for s in ("a", "b", "c", None)}
    expected = mixing.fair_targets(held, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(held.values()))
    assert all(k == v for k, v in sizes.items())
    for s, n in held.items():
        assert abs(targets[n] - expected[s]) < 1e-6
        assert targets[n] * 0.98 - 3 <= taken[n] <= targets[n] + 1
    again = mix_sources.mix_report(docs.repartition(9)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_repeats_and_leaves_out_as_reported(spark, make_docs):
    docs = make_docs(rows()).withColumnRenamed("lang", "pattern").withColumnRenamed("n_chars", "H")
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mix_sources.mix_report(docs).collect()}
    mixed = mix_sources.mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        key = (r["doc_id"], len((r["text"] or "").split()))
        times[key] = times.get(key, 0) + 1
    for (doc, size), words in taken.items():
        if size and doc != 5:
            assert times.get((doc, size), 0) * size == words


def plain_mix(rows, seed=7):
    """(id, size, source_size, target, taken) by sorting and running sums; rows of id, text, source."""
    sizes = [len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")) - (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ").count("") for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    weight, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, list(names)
    while open_:
        unit = (1.5 * sum(held.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * held[s]]
        target |= {s: float(2 * held[s]) for s in over} if over else {s: unit * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in over] if over else []
    copies = [0] * len(rows)
    for s in names:
        gap = min(round(target[s]), 2 * held[s])
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: spark_hash(int32(seed), rows[i][0], rows[i][1]) % (1 << 64))
        if held[s]:
            whole, gap = divmod(gap, held[s])
            for i in own:
                copies[i] = whole
        picked = set()
        while True:
            fitting, sum_ = [i for i in own if i not in picked and 0 < sizes[i] <= gap], 0
            for i in fitting:
                if sum_ + sizes[i] > gap:
                    break
                sum_ += sizes[i]
                picked.add(i)
                copies[i] += 1
            if not sum_:
                break
            gap -= sum_
    return [(r[0], n, held[r[2]], target[r[2]], n * c) for r, n, c in zip(rows, sizes, copies, strict=True)]


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_query_against_a_plain_version(spark):
    got = queries.op4_mix(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()
    expected = plain_mix(rows_of(spark, "documents", "doc_id", "text", "source"))
    assert [tuple(r) for r in sorted(got)] == [(*e[:3], pytest.approx(e[3]), e[4]) for e in sorted(expected)]


def test_documents_of_several_sources(spark, make_docs):
    docs = make_docs([(i, "w " * (i % 40 + 1)) for i in range(400)]).withColumn("source", F.expr("case doc_id % 5 when 0 then array('a', 'b') when 1 then array('b') when 2 then array('b', 'a', 'a') when 3 then array('c') end"))
    got = mix_sources.mix_report(docs).collect()
    by = {}
    for r in got:
        key = (r["source_size"], r["target"])
        by[key] = by.get(key, 0) + r["taken"]
    total = 1.5 * sum(r["size"] for r in got)
    assert len(by) == 4 and abs(sum(by.values()) - total) < 0.02 * total


def test_limits_against_sorting(spark):
    rng = random.Random(3)
    data = [("p", rng.randint(1, 9), rng.getrandbits(64) - (1 << 63)) for _ in range(3000)] + [("q", 4, 17)]
    got = mixing._limits(spark.createDataFrame(data, "pattern string, size bigint, h bigint"), {"p": 5000, "q": 3}, spark)
    total, last = 0, None
    for _, size, h in sorted(data[:-1], key=lambda r: r[2] % (1 << 64)):
        if total + size > 5000:
            break
        total, last = total + size, h
    assert got == {"p": (last ^ -(1 << 63), total)}


def test_empty(spark, make_docs):
    assert mix_sources.mix_report(make_docs([])).count() == 0
    assert mix_sources.mix(make_docs([])).count() == 0
    assert [r["taken"] for r in mix_sources.mix_report(make_docs([(1, None, "a")])).collect()] == [0]
