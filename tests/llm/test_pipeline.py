"""The pipeline against a plain version of each stage on its own input."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from brute import HAS_TABLES, SF, rows_of, spark_hash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_decontaminate import brute as overlap
from test_mixing import plain_mix
from test_models import brute_resample
from test_near_copies import kept_by_brute_force
from test_sharding import feistel
from textloom.llm import queries, sharding

needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in new.select("doc_id", "text", "source").collect()], new
        assert name == "sharding" or new.columns == docs.columns
        docs = new
    return out


@needs_tables
def test_quality_keeps_what_plain_counting_keeps(spark, stages):
    before, after, _ = stages["quality"]
    kept = {i for i, _, _, k in brute_resample([r[:2] for r in before], rows_of(spark, "labels", "doc_id", "quality")) if k}
    assert sorted(after) == sorted(r for r in before if r[0] in kept) and 0 < len(kept) < len(before)


@needs_tables
def test_near_dedup_keeps_one_of_each_group(stages):
    before, after, _ = stages["near_dedup"]
    kept = set(kept_by_brute_force([r[:2] for r in before]))
    assert sorted(after) == sorted(r for r in before if r[0] in kept) and len(kept) < len(before)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@needs_tables
def test_decontamination_drops_what_all_windows_show(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [words(t) for _, t in rows_of(spark, "benchmark", "item_id", "text")]
    known = {w for i in items for w in i}
    maybe = [r for r in before if sum(w in known for w in words(r[1])) >= 10]
    leaked = {r[0] for r in maybe if any(overlap(words(r[1]), i) for i in items if len(set(i) & set(words(r[1]))) >= 5)}
    assert sorted(after) == sorted(r for r in before if r[0] not in leaked) and leaked


@needs_tables
def test_mixing_takes_the_copies_of_the_plain_mix(stages):
    before, after, _ = stages["mixing"]
    times = Counter(after)
    for row, (_, size, _, _, taken) in zip(before, plain_mix(before), strict=True):
        assert times[row] * size == taken
    assert set(times) <= set(before)


@needs_tables
def test_sharding_places_every_row(stages):
    before, after, new = stages["sharding"]
    order = sorted((spark_hash(d, t) % sharding.LEAST_BUCKETS, spark_hash(d, t), d, t) for d, t, _ in before)
    places = [feistel(n, len(order), 0) for n in range(len(order))]
    expected = sorted((d, p % 16, p // 16) for (_, _, d, _), p in zip(order, places, strict=True))
    assert sorted(tuple(r) for r in new.select("doc_id", "shard", "slot").collect()) == expected
    assert sorted(before) == sorted(after)


@needs_tables
def test_run_gives_the_last_stage_and_leaves_nothing_else(spark, stages, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "shard", "slot").collect()))
    assert key(whole) == key(stages["sharding"][2])
    (top,) = tmp_path.glob("pipeline-*")
    assert [p.name for p in top.iterdir()] == ["sharding"]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, H string, root string, tie int, c0 int, pattern string"


def odd_rows():
    text = "some words of a text that is long enough to be compared with others by five of its words " * 3
    rows = [(None, None), (None, text), (1, None), (2, ""), (3, text), (3, text), (4, text.upper()), (5, "x"), (5, "another text of the same id"), (6, " \n"), (7, "one two three " * 30_000), (8, "leak " + " ".join(f"q{i}" for i in range(20)))]
    rows += [(i, f"document {i} says {' '.join(str(i * k % 97) for k in range(1, 40))}") for i in range(10, 60)]
    return [(i, t, None, (None, "a", "b")[n % 3], None, 1, None, "r", 2, None, "p") for n, (i, t) in enumerate(rows)]


def test_stages_with_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame(odd_rows(), ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(10, 40)] + [(None, 1), (3, None)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20))), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.select(*docs.columns).collect()), key=repr)
    everything = rows(docs)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns and not Counter(rows(good)) - Counter(everything)
    once = stage["near_dedup"](spark, docs, folder)
    left = [r[:2] for r in rows(once)]
    assert once.columns == docs.columns and len(left) == len(set(left))
    assert {r for r in left if r[0] is None or r[0] < 10} == {(1, None), (3, docs.where("doc_id = 3").first()["text"]), (5, "x"), (5, "another text of the same id"), (7, "one two three " * 30_000), (8, odd_rows()[11][1])}
    clean = stage["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and rows(clean) == [r for r in everything if r[0] != 8]
    mixed = stage["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(everything)
    placed = stage["sharding"](spark, docs, folder)
    assert placed.columns == [*docs.columns, "shard_", "slot"] and rows(placed) == everything
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), folder)
        assert empty.count() == 0 and empty.columns[: len(docs.columns)] == docs.columns, name


def test_every_query_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11))
