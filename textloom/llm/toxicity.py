"""Toxicity by compression distance.

Two zstandard dictionaries of equal length are made from labelled text. Both hold the
same sample of ordinary words; one adds the word beginnings and words that are
significantly (by a likelihood-ratio test) over-represented in toxic documents, the strongest first while there is room, the other as many bytes more of ordinary words. Each text
is cut into short windows at word ends; a window's gain is its compressed length with the
ordinary dictionary minus that with the toxic one. Three figures of a document's gains (mean over a
floor, largest, count, the last two with damped length) enter a logistic model whose weights and cut are calibrated
on labelled documents that the dictionaries haven't seen.

Generic dictionary training picks segments that are frequent, and toxic documents are mostly ordinary text: dictionaries trained that way
hardly differ. So the toxic dictionary's content is chosen by contrast. ``toxicity_figures.py`` measures both.

The fit uses a bounded sample of labelled rows (``most_toxic``, ``most_ordinary`` by seeded hash). Their texts are
read whole, on the executors, which send sketches, segment counts and figures; every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._common import chunks, free_name

#: Labelled rows that the fit uses at most.
MAX_TOXIC, MAX_ORDINARY = 2_500, 4_000
#: Window and gain floor in bytes; ordinary words in both dictionaries and as filler; significance and ratio that a segment needs; bytes of segments in the dictionary.
WINDOW, FLOOR, BASE_WORDS, FILLER_WORDS, Z, RATIO, SEGMENT_BYTES = 48, 1, 300, 2000, 4.5, 10.0, 1 << 14
OTHER = re.compile(rb"[^a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float

    def score(self, figures: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the calibrated cut."""
        z = ((figures - self.mean) / self.scale) @ self.weights + self.bias - self.cut
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def plain(data: bytes) -> bytes:
    """Lower-case words between single spaces, one at each end; one space without words."""
    return b" " + b"".join(w + b" " for w in OTHER.sub(b" ", data.lower()).split())


def windows(text: str | None):
    """Windows of at least WINDOW bytes (the last may be shorter) that cover the whole text, cut at word ends."""
    for piece in chunks((text or "").encode()):
        data = plain(piece)
        at, end = 0, len(data) - 1
        while at < end:
            to = data.find(b" ", at + WINDOW)
            to = end if to < 0 else to
            for part in range(at, to, 1 << 16):
                yield data[part : min(to, part + (1 << 16)) + 1]
            at = to


def segments(text: str) -> set[bytes]:
    """Words of 4 bytes up to a window's and word beginnings of 4 to 11 bytes, each with the space before."""
    out = set()
    for word in set(plain(text.encode()).split()):
        out.update(b" " + word[:k] for k in range(4, min(len(word), 12)))
        if 4 <= len(word) <= WINDOW:
            out.add(b" " + word + b" ")
    return out


def lowest_hashes(text: str, sketch: int = 8) -> list[int]:
    """The lowest hashes of a text's shingles (three words)."""
    words = plain(text.encode()).split()
    return sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:sketch]


def lowest_words(words: set[bytes]) -> list[bytes]:
    """The words of lowest hash that dictionaries need. Those of a union are among those of its parts."""
    return sorted(words, key=lambda w: (xxhash.xxh64_intdigest(w), w))[: BASE_WORDS + FILLER_WORDS]


def unlike(rows: list) -> list:
    """The rows without near copies of earlier ones, so that a much copied document counts once.

    A row goes if at least two of its lowest hashes are those of an earlier row.
    """
    seen: set[int] = set()
    out = []
    for row in rows:
        lowest = row["lowest"]
        if sum(h in seen for h in lowest) < min(2, len(lowest)):
            out.append(row)
        seen.update(lowest)
    return out


def contrast(counts: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int) -> list[bytes]:
    """Segments (with their toxic and ordinary documents) that are significantly more frequent in toxic ones, the strongest first (of equals the longest), none within another."""
    found = []
    for segment, k, z in counts:
        share, other, both = k / n_toxic, z / n_ordinary, (k + z) / (n_toxic + n_ordinary)
        if k < 4 or (z + 0.5) / (n_ordinary + 1) * RATIO > (k + 0.5) / (n_toxic + 1):
            continue
        ratio = sum(n * np.log(p / q) for n, p, q in ((k, share, both), (z, other, both), (n_toxic - k, 1 - share, 1 - both), (n_ordinary - z, 1 - other, 1 - both)) if n)
        if 2 * ratio >= Z * Z:
            found.append((-ratio, -len(segment), segment))
    picked: list[bytes] = []
    room = SEGMENT_BYTES
    for _, _, segment in sorted(found):
        bare = segment.strip()
        if len(segment) <= room and not any(bare in p or p.strip() in bare for p in picked):
            picked.append(segment)
            room -= len(segment)
    return picked


def dictionaries(words: list[bytes], picked: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, equally long."""
    base = b" " + b" ".join(words[:BASE_WORDS]) + b" "
    more = b"".join(reversed(picked))
    filler = b" " + b" ".join(words[BASE_WORDS:]) + b" "
    filler = (filler * (len(more) // len(filler) + 1))[: len(more)]
    return more + base, filler + base


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def figures(text: str | None, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Root of the mean gain above the floor, largest gain, log of the count of windows above twice the floor; zeros for an empty text."""
    n, total, most, many = 0, 0, 0, 0
    for w in windows(text):
        gain = len(ordinary.compress(w)) - len(toxic.compress(w))
        n += 1
        total += max(0, gain - FLOOR)
        most = max(most, gain)
        many += gain > 2 * FLOOR
    return (total / n) ** 0.5 if n else 0.0, float(most), float(np.log1p(many) - 0.5 * np.log1p(n)) if n else 0.0


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Logistic regression with a small ridge, by Newton's method, and the cut of highest F1."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(hess, a.T @ (p - y) + 1e-2 * w)
    z = a @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.diff(-z[order]) > 1e-9)  # cuts lie between different values, with something on either side
    if len(ends):
        at = ends[np.argmax(f1[ends])]
        cut = (z[order[at]] + z[order[at + 1]]) / 2
    else:
        cut = z.max() + 1
    return mean, scale, w[:-1], float(w[-1]), float(cut)


def held_out(id_col: str) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text, mod 5, is 0 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5, most_toxic: int = MAX_TOXIC, most_ordinary: int = MAX_ORDINARY) -> Model | None:
    """A model from labelled texts; dictionaries from the first 60 % of either kind, weights from the rest. None without both kinds."""
    spark, id_kind = docs.sparkSession, labels.schema[id_col].dataType.simpleString()
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("at"), F.col(text_col).alias("text"))

    def sketch(batches):
        for batch in batches:
            lowest = [[h - (1 << 64) if h >> 63 else h for h in lowest_hashes(t)] for t in batch["text"]]
            yield batch[["id", "at"]].assign(lowest=lowest)

    places = []
    for kind, most in ((1, most_toxic), (0, most_ordinary)):
        ids = usable.where((F.col("toxic") > 0) == F.lit(bool(kind))).orderBy(order, id_col).limit(most).select(id_col).collect()
        if not ids:
            return None
        picked = spark.createDataFrame([tuple(r) for r in ids], f"id {id_kind}")
        rows = texts.join(F.broadcast(picked), "id", "left_semi").mapInPandas(sketch, f"id {id_kind}, at string, lowest array<bigint>")
        rows = unlike(rows.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id", "at").limit(most).collect())
        if len(rows) < 2:
            return None
        places.append([(r["id"], r["at"], kind, n) for n, r in enumerate(rows)])
    a, b = (max(1, len(p) * 6 // 10) for p in places)
    chosen = lambda rows: texts.join(F.broadcast(spark.createDataFrame(rows, f"id {id_kind}, at string, kind int, place int")), ["id", "at"]).dropDuplicates(["kind", "place"])

    def split(batches):
        for batch in batches:
            for text, kind in zip(batch["text"], batch["kind"], strict=True):
                yield pd.DataFrame({"segment": sorted(segments(text)), "kind": kind})

    def least(batches):
        words: set[bytes] = set()
        for batch in batches:
            for text in batch["text"]:
                words = set(lowest_words(words | set(plain(text.encode()).split())))
        yield pd.DataFrame({"word": sorted(words)})

    learned = chosen(places[0][:a] + places[1][:b])
    counts = learned.mapInPandas(split, "segment binary, kind int").groupBy("segment").agg(F.sum("kind").alias("k"), F.sum(1 - F.col("kind")).alias("z")).where("k >= 4").collect()
    words = chosen(places[1][:b]).mapInPandas(least, "word binary").distinct().collect()
    contents = dictionaries(lowest_words({bytes(r["word"]) for r in words}), contrast([(bytes(r["segment"]), r["k"], r["z"]) for r in counts], a, b))

    def measure(batches):
        pair = [compressor(c) for c in contents]
        for batch in batches:
            x = np.array([figures(t, *pair) for t in batch["text"]]).reshape(-1, 3)
            yield batch[["kind", "place"]].assign(mean=x[:, 0], most=x[:, 1], many=x[:, 2])

    rest = chosen(places[0][a:] + places[1][b:]).mapInPandas(measure, "kind int, place int, mean double, most double, many double").collect()
    rest.sort(key=lambda r: (-r["kind"], r["place"]))
    return Model(*contents, *calibrate(np.array([tuple(r)[2:] for r in rest]), np.array([float(r["kind"]) for r in rest])))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5, **bounds) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int: score of 0.5 or more) appended.

    Null, empty and wordless texts get the score of a text without gains. Labels without one of the two classes give every row score 0.
    Equal texts get equal scores, and repeated rows each get theirs; long texts are scored whole, window by window. Null ids are scored, never learned from. An empty table gives an empty result.
    """
    model = fit_labelled(docs, labels, id_col, text_col, label_col, seed, **bounds)
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    if model is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(predicted, F.lit(0))

    def rate(texts: pd.Series) -> pd.Series:
        pair = compressor(model.toxic), compressor(model.ordinary)
        return pd.Series(model.score(np.array([figures(t, *pair) for t in texts]).reshape(-1, 3)), dtype="float64")

    rated = docs.withColumn(score, F.pandas_udf(rate, "double")(F.col(text_col)))
    return rated.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
