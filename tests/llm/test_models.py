import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import HAS_TABLES, SF, int32, rows_of, spark_hash
from pyspark.sql import functions as F

from textloom.llm import importance, queries, toxicity

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 9))) for _ in range(300)]


def good(n=60):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


MASK = (1 << 64) - 1
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & MASK
    return x ^ x >> 33


def brute_grams(text):
    """Buckets of all words, then of all neighbouring pairs."""
    found = TOKEN.findall((text or "").encode().lower())
    one = [mixed(sum((c + 1) * pow(importance.FACTOR, i, 1 << 64) for i, c in enumerate(t)) & MASK) for t in found]
    two = [mixed(a * importance.FACTOR & MASK ^ b) for a, b in zip(one, one[1:], strict=False)]
    return [h % importance.BUCKETS for h in one + two]


def by_text(texts):
    out = [[] for _ in texts]
    for numbers, found in importance.grams(texts):
        for n, f in zip(numbers.tolist(), found.tolist(), strict=True):
            out[n].append(f)
    return out


def test_grams_against_a_plain_count(monkeypatch):
    texts = ["One two, two!! é " + "x" * 10, None, "", " \n", "a", "#", "ünï ß\x1fy\x0bz", *(good(rng.randint(0, 40)) for _ in range(50)), "word " * 300, good(200) + "\n" + good(50)]
    assert [sorted(f) for f in by_text(texts)] == [sorted(brute_grams(t)) for t in texts]
    monkeypatch.setattr(importance, "BLOCK", 300)
    assert [sorted(f) for f in by_text(texts)] == [sorted(brute_grams(t)) for t in texts]
    assert len(by_text(["x" * 1000])[0]) == 4 + 3  # cut into parts


def brute_resample(docs, labels, seed=11):
    """(id, weight, perturbed, kept) from (id, text) and (id, quality), by plain counting."""
    label = {}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = min(q, label.get(i, q))
    order = sorted(label, key=lambda i: (spark_hash(int32(seed), i), i))
    kinds = [[i for i in order if label[i] > 0], [i for i in order if label[i] <= 0]]
    half = max(1, len(kinds[0]) // 2)
    target, raw = Counter(), Counter()
    for i, text in docs:
        raw.update(brute_grams(text))
        if i in kinds[0][:half]:
            target.update(brute_grams(text))
    sizes = sum(target.values()) + importance.BUCKETS, sum(raw.values()) + importance.BUCKETS
    weight = [sum(math.log((target[g] + 1) / sizes[0]) - math.log((raw[g] + 1) / sizes[1]) for g in brute_grams(t)) for _, t in docs]
    good_, bad = ([w for w, (i, _) in zip(weight, docs, strict=True) if i in of] for of in (kinds[0][half:], kinds[1]))
    values = sorted(good_ + bad)
    loss = lambda c: sum(g < c for g in good_) / len(good_) + sum(b >= c for b in bad) / len(bad)
    cut = min([values[0], *((a + b) / 2 for a, b in zip(values, values[1:], strict=False)), values[-1] + 1], key=loss)
    noise = [-math.log(-math.log(((spark_hash(int32(seed), i, spark_hash(t)) & MASK) >> 11) / 2**53 + 0.5 / 2**53)) for i, t in docs]
    perturbed = [w + g for w, g in zip(weight, noise, strict=True)]
    k = sum(w >= cut for w in weight)
    least = sorted(perturbed)[-k] if k else math.inf
    return [(i, w, p, p >= least) for (i, _), w, p in zip(docs, weight, perturbed, strict=True)]


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_quality_query_against_brute_force(spark):
    expected = brute_resample(rows_of(spark, "documents", "doc_id", "text"), rows_of(spark, "labels", "doc_id", "quality"))
    got = sorted(map(tuple, queries.op1_quality(spark, SF).select("doc_id", "log_weight", "perturbed", "kept").collect()))
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[0] == b[0] and a[3] == b[3] and a[1:3] == pytest.approx(b[1:3], rel=1e-9, abs=1e-9)


def test_kth_largest(spark):
    values = [rng.gauss(0, 100) for _ in range(2000)] + [5.0] * 300 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1300, len(values)):
        assert importance.kth_largest(df, "x", k, bins=16) == sorted(values)[-k]
    assert importance.kth_largest(df, "x", len(values) + 1) is None
    assert importance.kth_largest(df.limit(0), "x", 1) is None


def quality_tables(spark, make_docs):
    rows = [(i, good()) for i in range(300)] + [(1000 + i, " ".join(rng.choice("#$%*") * 3 + str(rng.randint(0, 9)) for _ in range(50))) for i in range(60)] + [(2000, None), (2001, ""), (None, good()), (7, good())]
    docs = make_docs(rows).withColumnRenamed("lang", "log_weight")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)] + [(1000 + i, 0) for i in range(0, 60, 3)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    return docs, labels


def test_resampling_keeps_good_and_rejects_bad(spark, make_docs):
    docs, labels = quality_tables(spark, make_docs)
    got = importance.resample(docs, labels)
    assert got.columns == ["doc_id", "log_weight_", "perturbed", "kept"]
    rows = got.collect()
    assert len(rows) == docs.count()
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sum(1 for i in kept if i is not None and i < 300) >= 297 and not any(i is not None and 1000 <= i < 2000 for i in kept)
    assert len(kept) == len(importance.keep_good(docs, labels).collect())
    assert importance.keep_good(docs, labels).columns == docs.columns
    # k highest perturbed weights
    assert min(r["perturbed"] for r in rows if r["kept"]) >= max(r["perturbed"] for r in rows if not r["kept"])


def test_importance_without_labels_or_rows(spark, make_docs):
    docs, labels = quality_tables(spark, make_docs)
    assert importance.resample(docs, labels.limit(0)).where(~F.col("kept")).count() == 0
    assert importance.resample(docs.limit(0), labels).count() == 0


def toxic_tables(spark, make_docs):
    slurs = ["gnarlwort", "blightface", "mudsnout"]
    rows = []
    for i in range(900):
        words = good(80).split()
        if i % 6 == 0:
            for s in slurs:
                words.insert(rng.randrange(len(words)), s)
        rows.append((i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "!!!"), (None, rows[0][1]), (6, rows[6][1])]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(None, 1), (3000, None)], "doc_id bigint, toxic int")
    return make_docs(rows).withColumnRenamed("lang", "score"), labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = toxic_tables(spark, make_docs)
    out = toxicity.classify(docs, labels).withColumn("held_out", toxicity.held_out("doc_id"))
    assert out.columns == [*docs.columns, "score_", "predicted", "held_out"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score_"] <= 1 and r["predicted"] == (r["score_"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) >= 0.95
    empty = {r["doc_id"]: r["score_"] for r in rows}
    assert empty[2000] == empty[2001] == empty[2002] < 0.5
    assert len({r["score_"] for r in rows if r["doc_id"] == 6}) == 1


def test_toxicity_learns_from_permitted_labels_only(spark, make_docs):
    docs, labels = toxic_tables(spark, make_docs)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.classify(docs, x).select("doc_id", "text", "score_").collect() for x in (labels, flipped))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_toxicity_without_a_class(spark, make_docs):
    docs, labels = toxic_tables(spark, make_docs)
    assert {r["score_"] for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_whole_texts(spark, make_docs):
    slurs, rows = ["gnarlwort", "blightface", "mudsnout"], []
    for i in range(240):
        words = good(3500)
        rows.append((i, words + " " + " ".join(slurs * 20) if i % 3 == 0 else words))
    assert all(r[1].find(slurs[0]) in (-1, *range(20_001, len(r[1]))) for r in rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    model = toxicity.fit_labelled(make_docs(rows), labels, "doc_id", "text", "toxic", 5)
    assert all(s.encode() in model.toxic and s.encode() not in model.ordinary for s in slurs)


def words_of(text):
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").encode().lower()).split()


def test_windows_cover_the_text():
    for text in ("", "one", "a b c " * 50, "Été, 12 ans!", "x" * 300_000, "word " * 300_000):
        found = list(toxicity.windows(text))
        if len(text) != 300_000:
            assert [x for w in found for x in w.split()] == words_of(text)
        assert sum(len(w) - w.startswith(b" ") for w in found) >= len(b"".join(words_of(text)))
        assert sum(len(w) < toxicity.WINDOW for w in found) <= 1 + len(text) // (1 << 20)  # only where a block of the text ends
        if len(text) < 300_000:
            assert found == list(brute_windows(text))


def brute_windows(text):
    """Whole words, a window closed as soon as it holds WINDOW bytes after its first."""
    now = b" "
    for word in words_of(text):
        now += word + b" "
        if len(now) > toxicity.WINDOW:
            yield now
            now = b" "
    if now != b" ":
        yield now


def brute_score(docs, labels, seed=5):
    """Scores of (id, text) from (id, toxic), in one process and with plain counting."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    label = {}
    for i, y in labels:
        if i is not None and y is not None and not held(i):
            label[i] = max(y, label.get(i, y))
    order = sorted((d for d in docs if d[0] in label and d[1] is not None), key=lambda d: (spark_hash(int32(seed), d[0]), d[0]))
    kinds = []
    for kind in (1, 0):
        seen, kept = set(), []
        for i, t in order:
            if (label[i] > 0) == bool(kind):
                w = words_of(t)
                lowest = sorted({xxhash.xxh64_intdigest(b" ".join(w[j : j + 3])) for j in range(max(1, len(w) - 2))})[:8]
                if len(seen.intersection(lowest)) < min(2, len(lowest)):
                    kept.append(t)
                seen.update(lowest)
        kinds.append(kept)
    a, b = (max(1, len(k) * 6 // 10) for k in kinds)
    parts = lambda t: {p for w in words_of(t) for p in [b" " + w[:k] for k in range(4, 12) if k < len(w)] + ([b" " + w + b" "] if 4 <= len(w) <= toxicity.WINDOW else [])}
    k, z = (Counter(p for t in texts for p in parts(t)) for texts in (kinds[0][:a], kinds[1][:b]))
    rated = []
    for p in k:
        if k[p] >= 4 and (z[p] + 0.5) / (b + 1) * toxicity.RATIO <= (k[p] + 0.5) / (a + 1):
            table, all_ = ((k[p], a), (z[p], b)), (k[p] + z[p]) / (a + b)
            ratio = sum(n * math.log(n / m / q) for x, m in table for n, q in ((x, all_), (m - x, 1 - all_)) if n)
            if 2 * ratio >= toxicity.Z**2:
                rated.append((-round(ratio, 9), -len(p), p))
    picked = []
    for _, _, p in sorted(rated):
        if not any(p.strip() in q or q.strip() in p.strip() for q in picked):
            picked.append(p)
    words = sorted({w for t in kinds[1][:b] for w in words_of(t)}, key=lambda w: (xxhash.xxh64_intdigest(w), w))
    base, more = b" " + b" ".join(words[:300]) + b" ", b"".join(reversed(picked))
    filler = b" " + b" ".join(words[300:2300]) + b" "
    pair = [toxicity.compressor(x + base) for x in (more, (filler * (len(more) // len(filler) + 1))[: len(more)])]

    def figures(text):
        gains = [len(pair[1].compress(w)) - len(pair[0].compress(w)) for w in brute_windows(text)]
        n = len(gains)
        return [math.sqrt(sum(max(0, g - 1) for g in gains) / n), max(0, *gains, 0), math.log1p(sum(g > 2 for g in gains)) - 0.5 * math.log1p(n)] if n else [0.0] * 3

    x, y = np.array([figures(t) for t in kinds[0][a:] + kinds[1][b:]]), np.array([1.0] * len(kinds[0][a:]) + [0.0] * len(kinds[1][b:]))
    return [toxicity.Model(b"", b"", *toxicity.calibrate(x, y)).score(np.array([figures(t)]))[0] for _, t in docs]


def test_calibration_is_the_least_loss_and_the_best_cut():
    some = np.random.default_rng(3)
    x, y = some.normal(size=(80, 3)), (np.arange(80) % 3 == 0).astype(float)
    x[:, 0] += 2 * y
    mean, scale, w, bias, cut = toxicity.calibrate(x, y)
    a = (x - mean) / scale
    loss = lambda w, c: np.log1p(np.exp(-(2 * y - 1) * (a @ w + c))).sum() + 5e-3 * (w @ w + c * c)
    assert all(loss(w, bias) <= loss(w + d, bias + e) for d in (some.normal(size=3) * 0.01 for _ in range(50)) for e in (-0.01, 0, 0.01))
    f1 = lambda c: 2 * y[a @ w + bias > c].sum() / ((a @ w + bias > c).sum() + y.sum())
    assert f1(cut) == pytest.approx(max(f1(c) for c in np.sort(a @ w + bias)[:-1]))


@pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")
def test_toxicity_query_against_brute_force(spark):
    rows = rows_of(spark, "documents", "doc_id", "text")
    expected = brute_score(rows, rows_of(spark, "labels", "doc_id", "toxic"))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, _), score in zip(rows, expected, strict=True):
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == (got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
