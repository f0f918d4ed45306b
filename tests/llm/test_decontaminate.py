import random
from itertools import combinations

import pytest

from textloom.llm import _common, decontaminate

rng = random.Random(5)
WORDS = [f"b{i}" for i in range(60)]
NOISE = lambda n: [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
ITEMS = {n: [f"i{n}x{rng.randint(0, 10**6)}" for _ in range(n)] for n in range(1, 41)}
ITEMS[60] = [rng.choice(WORDS[:3]) for _ in range(60)]  # few words, many diagonals
ITEMS[2500] = [f"l{rng.randint(0, 10**6)}" for _ in range(2500)]


def substituted(words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"s{rng.randint(0, 10**6)}"
    return out


def brute(words, item):
    """First and last word and the best share over all windows on all diagonals; None without one."""
    n, w = len(item), min(13, len(item))
    need = n if n < 8 else -(-3 * w // 4)
    ends = []
    for d in range(-n + 1, len(words)):
        equal = [0 <= d + j < len(words) and words[d + j] == item[j] for j in range(n)]
        if sum(equal) >= need:
            ends += [(max(0, d + s), min(d + s + w, len(words)) - 1, sum(equal[s : s + w]) / w) for s in range(n - w + 1) if sum(equal[s : s + w]) >= need]
    return (min(e[0] for e in ends), max(e[1] for e in ends), max(e[2] for e in ends)) if ends and n >= 3 else None


def corpus():
    out = []
    for n, item in ITEMS.items():
        if n <= 40:
            for k in {0, n // 8, n // 5, n // 4, n // 3}:
                out.append(NOISE(rng.randint(0, 20)) + substituted(item, k) + NOISE(rng.randint(0, 20)))
            out.append(NOISE(5) + item[n // 4 :])
    long = ITEMS[2500]
    out += [long, NOISE(3) + substituted(long[980:1010], 6), long[993:1006], long[-14:], ITEMS[60], substituted(ITEMS[60] * 2, 30), NOISE(2000) + ITEMS[20] + NOISE(2000) + ITEMS[20][5:], [w.upper() for w in ITEMS[15]], NOISE(100)]
    return out


@pytest.mark.parametrize("n", range(8, 14))
def test_masks_cover_every_way_to_substitute(n):
    m = decontaminate.substitutions(n)
    masks = decontaminate.covering(n, m)
    assert m == n // 4 and all(mask[p : p + len(core)].count("1") >= core.count("1") for mask, core, p in masks)
    for case in combinations(range(n), m):
        assert any(not {s + o for o in decontaminate._offsets(mask)} & set(case) for mask, _, _ in masks for s in range(n - len(mask) + 1))


def test_recall_is_whole_against_all_windows(spark, make_docs, monkeypatch):
    texts = corpus()
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    odd = [(None, " ".join(ITEMS[20])), (3, " ".join(ITEMS[30])), (3, " ".join(ITEMS[30])), (9000, None), (9001, ""), (9002, "...")]
    docs = make_docs(rows + odd).withColumnRenamed("lang", "seed").withColumnRenamed("source", "words").withColumnRenamed("n_chars", "b")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in ITEMS.items()] + [(100, " ".join(ITEMS[20])), (20, " ".join(ITEMS[20])), (200, None), (201, "")], "item_id bigint, text string")
    wanted = {}
    for i, words in enumerate(texts):
        for n, item in ITEMS.items():
            found = brute([w.lower() for w in words], item)
            if found:
                wanted[i, n] = found
                if n == 20:
                    wanted[i, 100] = found
    for n in (20, 100):
        wanted[None, n] = (0, 19, 1.0)
    wanted[3, 30] = (0, 29, 1.0)
    assert sum(1 for k in wanted if isinstance(k[0], int) and k[1] < 8) >= 5 and sum(1 for v in wanted.values() if v[2] < 0.8) >= 10
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["equal_share"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == wanted
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {k[0] for k in wanted}
    left = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect() if r["text"])
    clean = [(i, t) for i, t in rows if i not in bad or (i == 3 and brute(t.split(), ITEMS[3]) is None and not any(brute(t.split(), x) for x in ITEMS.values()))]
    assert left == sorted([*clean, (9002, "...")])
    # in many blocks, and with nothing broadcast by its size
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(decontaminate, "MOST_KEYS", 0)
    monkeypatch.setattr(_common, "MOST_KEYS", 0)
    again = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["equal_share"]) for r in decontaminate.report(docs, bench).collect()}
    assert again == wanted
    assert decontaminate.clean(docs, bench).count() == kept.count()


def test_empty_tables(spark, make_docs):
    docs = make_docs([(1, " ".join(ITEMS[20])), (2, None), (None, "")])
    bench = spark.createDataFrame([(1, " ".join(ITEMS[20])), (2, "too short"[:3])], "item_id bigint, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 3
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [2, None]
