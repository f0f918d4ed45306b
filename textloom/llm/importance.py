"""Quality classifier by importance resampling.

Two bag-of-n-gram models over hashed words and word pairs: one of a target (documents
labelled good), one of the raw text (all documents). A document's log importance weight is the
sum over its n-grams of log target probability minus log raw probability. The corpus is resampled
without replacement: Gumbel noise is added to the log weights and the k highest
are kept. k is the number of documents whose weight reaches a cut that is calibrated on labelled documents, so it
follows the corpus. With a cut given, no labels of bad documents are needed.

The raw model counts every word of every document. The target model and the cut are fitted on a bounded sample of
labelled rows (``most_labelled``, by seeded hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._common import free_name, recovery_point

#: Hashed n-gram buckets; labelled rows that are used at most; bytes of text that are counted at a time.
BUCKETS, MAX_LABELLED, BLOCK = 10_000, 20_000, 1 << 18
#: Kinds of bytes: white space (0), letters, digits and all from 128 on (1), other signs (2). A token is a run of one of the last two kinds.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
#: An odd number, its inverse modulo 2 ** 64, and the powers of both.
FACTOR = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, x, np.uint64)]), dtype=np.uint64) for x in (np.uint64(FACTOR), np.uint64(pow(FACTOR, -1, 1 << 64))))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of at most BLOCK bytes that end at a space or line end. A run of BLOCK bytes without one is cut: its tokens count in parts."""
    start = 0
    while len(data) - start > BLOCK:
        cut = max(data.rfind(b" ", start + 1, start + BLOCK), data.rfind(b"\n", start + 1, start + BLOCK))
        cut = cut if cut > start else start + BLOCK
        yield data[start:cut]
        start = cut
    yield data[start:]


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the tokens: sums of (byte + 1) * FACTOR ** place, mixed."""
    raw = np.frombuffer(data, np.uint8)
    kind = np.concatenate([[0], KIND[raw], [0]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    own = kind[edge + 1] > 0  # an edge starts a token unless white space follows
    start, stop = edge[own], edge[1:][own[:-1]]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], dtype=np.uint64)])
    return start, _mixed((sums[stop] - sums[start]) * _INVERSES[start])


def _pairs(one: np.ndarray) -> np.ndarray:
    return _mixed(one[:-1] * np.uint64(FACTOR) ^ one[1:])


def grams(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the texts and buckets of all their words and neighbouring pairs, in blocks.

    Short texts share a block; a text of more than one block has its blocks to itself. So what is given for a text doesn't depend on others.
    """
    shared: list[tuple[int, bytes]] = []
    room = BLOCK
    for number, text in enumerate(texts):
        data = (text or "").encode().lower()
        if len(data) + 1 > room and shared:
            yield _block(shared)
            shared, room = [], BLOCK
        if len(data) + 1 <= BLOCK:
            shared.append((number, data))
            room -= len(data) + 1
            continue
        last = np.zeros(0, np.uint64)
        for piece in pieces(data):
            _, one = _tokens(piece)
            run = np.concatenate([last, one])
            found = np.concatenate([one, _pairs(run)]) % np.uint64(BUCKETS)
            yield np.full(len(found), number), found.astype(np.int64)
            last = run[-1:]
    if shared:
        yield _block(shared)


def _block(shared: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts joined by line ends; pairs across texts are left out."""
    start, one = _tokens(b"\n".join(data for _, data in shared))
    ends = np.cumsum([len(data) + 1 for _, data in shared])
    at = np.searchsorted(ends, start, side="right")
    inside = at[:-1] == at[1:]
    numbers = np.array([n for n, _ in shared])
    return numbers[np.concatenate([at, at[:-1][inside]])], (np.concatenate([one, _pairs(one)[inside]]) % np.uint64(BUCKETS)).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each bucket occurs in all texts. Each task sends one number a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, found in grams(batch.iloc[:, 0]):
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    counts = docs.select(text_col).mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[counts["bucket"]] = counts["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, both smoothed by one."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weight(text: Column, ratio: np.ndarray) -> Column:
    """The log importance weight of a text; 0 for null and empty texts."""

    def weigh(texts: pd.Series) -> pd.Series:
        total = np.zeros(len(texts))
        for numbers, found in grams(texts):
            total += np.bincount(numbers, ratio[found], minlength=len(texts))
        return pd.Series(total)

    return F.pandas_udf(weigh, "double")(text)


def gumbel(seed: int, *of: Column) -> Column:
    """Gumbel noise that depends on the seed and the given columns only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a column without nulls, by histograms that narrow down; None if there are fewer."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 1 <= k <= n:
        return None
    left = k
    while low < high:
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        inside = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        rows = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        if len(rows) == 1 and low < high and high - low < 1e-300:
            break
    return high


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which on documents count as good: least sum of both error rates, halfway between neighbours."""
    values = np.concatenate([good, bad])
    order = np.argsort(values, kind="stable")
    is_good = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])[order]
    lost, kept = np.concatenate([[0], np.cumsum(is_good)]) / len(good), 1 - np.concatenate([[0], np.cumsum(1 - is_good)]) / len(bad)
    at = int(np.argmin(lost + kept))
    ordered = values[order]
    if at == 0:
        return float(ordered[0])
    if at == len(ordered):
        return float(np.nextafter(ordered[-1], np.inf))
    return float((ordered[at - 1] + ordered[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11, most_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """The buckets' log ratio, and the cut. Without good labels the ratio is 0 and the cut keeps all; without bad ones the cut keeps all."""
    spark = docs.sparkSession
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    rows = sample.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(most_labelled).collect()
    good, bad = [r[0] for r in rows if r[1] > 0], [r[0] for r in rows if r[1] <= 0]
    if not good:
        return np.zeros(BUCKETS), -np.inf
    kind = labels.schema[id_col].dataType.simpleString()
    pick = lambda ids: docs.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], f"`{id_col}` {kind}")), id_col, "left_semi")
    half = max(1, len(good) // 2)
    ratio = log_ratio(count_grams(pick(good[:half]), text_col), count_grams(docs, text_col))
    if not bad:
        return ratio, -np.inf
    scores = [pick(ids).select(log_weight(F.col(text_col), ratio).alias("w")).toPandas()["w"].to_numpy() for ids in (good[half:] or good, bad)]
    return ratio, best_cut(*scores) if len(scores[0]) and len(scores[1]) else -np.inf


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, seed: int, names: tuple[str, str]) -> DataFrame:
    """``docs`` with its log weight and its perturbed weight appended."""
    weighed = docs.withColumn(names[0], log_weight(F.col(text_col), ratio))
    return weighed.withColumn(names[1], F.col(names[0]) + gumbel(seed, F.col(id_col), F.xxhash64(text_col)))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11, k: int | None = None, most_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, log_weight, perturbed, kept (boolean).

    Null and empty texts weigh 0; long texts are counted whole, block by block. Equal rows get equal noise and are kept or rejected together; so all
    ties of the k-th highest perturbed weight are kept. Null ids take part. Other columns aren't read. An empty table gives an empty result.
    """
    ratio, cut = fit(docs, labels, id_col, text_col, label_col, seed, most_labelled)
    names = free_name(docs, "log_weight"), free_name(docs, "perturbed")
    scored = recovery_point(weigh(docs.select(id_col, text_col), ratio, id_col, text_col, seed, names).select(id_col, *names))
    least = _least(scored, names, cut, k)
    return scored.withColumn("kept", F.col(names[1]) >= F.lit(least) if least is not None else F.lit(False))


def _least(scored: DataFrame, names: tuple[str, str], cut: float, k: int | None) -> float | None:
    k = scored.where(F.col(names[0]) >= F.lit(float(cut))).count() if k is None else k
    return kth_largest(scored, names[1], k)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, as ``resample`` says. Texts are weighed twice instead of moving between executors."""
    ratio, cut = fit(docs, labels, id_col, text_col, label_col, seed)
    names = free_name(docs, "log_weight"), free_name(docs, "perturbed")
    scored = recovery_point(weigh(docs.select(id_col, text_col), ratio, id_col, text_col, seed, names).select(*names))
    least = _least(scored, names, cut, None)
    kept = weigh(docs, ratio, id_col, text_col, seed, names)
    return kept.where(F.col(names[1]) >= F.lit(least) if least is not None else F.lit(False)).select(*docs.columns)
