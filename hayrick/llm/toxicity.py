"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on what
toxic text has besides. A window is compressed once with the ordinary dictionary and once
with the toxic one, which is the ordinary one carried on; the bytes saved are its distance.
The largest distance of a text's overlapping windows, less what the largest of as many
ordinary windows is likely to have more than one has, and the mean over all its windows of
the positive ones, go through a logistic calibration. Of n windows whose distances have a tail
that falls by e every `tail` bytes, the largest grows by tail * ln n; the tail is measured on the
ordinary training windows. So neither grows with the length of the text as such.

Spelling. Zstandard counts whole bytes and prices rare letters by the bit, so that a short
word known to a dictionary saves hardly a byte, and any two texts share pieces of words. So
the compressor reads texts spelled by beginnings of words: each place of a word is two bytes
that stand for the word up to that place. Two words then have as many bytes in common as
they have first letters in common, matches begin where words do, and no byte is cheaper than
another. Letters only, in lower case; of words longer than `PLACES`, the rest is one place.

The toxic dictionary is trained on the places that are in at least `share` of the toxic
training texts (and 4), in several times the share of ordinary ones: otherwise it fills up
with what either class has, and the distances measure its size.

Training is bounded: the `most` labelled rows of either class with the smallest hash of
their id. Counts of places, windows and features are computed where the texts are; the driver
gets counts of the places that stand out, up to `PER_TEXT` bytes or windows of a text, and
two numbers a text. Ids decide only what is learned from; labels, languages, sources and ids
are no inputs of a score. Distances for the calibration come from dictionaries of the other
half of the sample.

Defined cases: null and empty texts have no words and get the score of distance 0; very
long texts are read whole, window by window; repeated rows score alike; an empty table
gives no rows; without labelled rows of both classes every score is the share of toxic
labels (0 if there are none); other columns are kept, but for one named as the score, which
is replaced; labels that repeat for a document count once each, and null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hayrick.llm import common

WORDS = re.compile(r"[^\W\d_]+")
WINDOW, STEP, PLACES = 48, 32, 9
_BASE = 0x9E3779B97F4A7C15
THRESHOLD = 0.3
#: What a text gives to the dictionaries at most: so many ordinary windows of 64 words, or toxic pieces of 128 bytes.
PER_TEXT, PER_TOXIC = 4, 8


def places(word: str) -> list[str]:
    """A word up to each of its first places, and the whole word with its end."""
    return [*(word[:k] for k in range(1, min(len(word), PLACES) + 1)), word + " "]


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes for each place of each word, and where the words begin among them (one more at the end).

    A place is known by a polynomial of its letters, mixed; a word's end by its mixed again.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(letters)) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max(initial=0)) + 1, _BASE, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * np.cumprod(powers)[at])])
    known = common.mix(sums[1:] - np.repeat(sums[first], sizes))
    whole = common.mix(common.mix(sums[first + sizes] - sums[first]) + np.uint64(1))
    counts = np.minimum(sizes, PLACES) + 1
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(begins[-1]), np.uint64)
    ends = np.zeros(len(out), bool)
    ends[begins[1:] - 1] = True
    out[ends], out[~ends] = whole, known[at < PLACES]
    return (out >> np.uint64(48)).astype("<u2"), begins


class Speller:
    """Texts in their spelling, as windows of words."""

    def windows(self, text: str, words: int = WINDOW, step: int = STEP) -> list[bytes]:
        found = WORDS.findall(text.lower())
        if not found:
            return []
        codes, begins = spell(found)
        data, at = codes.tobytes(), (2 * begins).tolist()
        last = len(found)
        return [data[at[a] : at[min(a + words, last)]] for a in range(0, max(last - words + step, 1), step)]


class Distance:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = 3):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

        # A dictionary's content may be carried on at its end. Zeros in the toxic one's place
        # keep the ordinary one equally far away.
        self.plain, self.both = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)

    def of(self, windows: list[bytes]) -> np.ndarray:
        plain, both = self.plain.compress, self.both.compress
        return np.fromiter((len(plain(w)) - len(both(w)) for w in windows), np.float64, len(windows))


def features(distances: np.ndarray, tail: float = 0.0) -> tuple[float, float]:
    """The largest distance less what chance adds to the largest of so many, and the mean of the positive ones over all."""
    d = distances
    return (float(d.max()) - tail * math.log(len(d)), float(np.maximum(d, 0).mean())) if len(d) else (0.0, 0.0)


def tail_of(distances: np.ndarray, counts: np.ndarray) -> float:
    """By how many bytes the upper tail of ordinary windows falls to the e-th part, between its median and its fiftieth part."""
    if not counts.sum():
        return 0.0
    order = np.argsort(distances)
    share = np.cumsum(counts[order]) / counts.sum()
    at = lambda p: float(distances[order][np.searchsorted(share, p - 1e-12)])
    return (at(0.98) - at(0.5)) / math.log(0.5 / 0.02)


def train_dictionary(samples: list[bytes], size: int, **segments: int) -> bytes:
    """A trained dictionary; of too little text, that text's end."""
    text = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(512, len(text) // 4)), samples, level=3, **segments).as_bytes()
    except zstandard.ZstdError:
        return text[-size:]


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; the last weight is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3] * (a.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * len(x), a.T @ (y - p) - ridge @ w * len(x))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Two dictionaries and the calibration; without dictionaries, a constant."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, tail: float = 0.0):
        self.ordinary, self.toxic, self.weights, self.tail = ordinary, toxic, weights, tail

    def scorer(self):
        if not self.ordinary:
            return lambda text: float(self.weights[-1])
        speller, distance, w = Speller(), Distance(self.ordinary, self.toxic), self.weights

        def score(text: str) -> float:
            f = features(distance.of(speller.windows(text)), self.tail)
            return float(1 / (1 + np.exp(-np.clip(f[0] * w[0] + f[1] * w[1] + w[2], -30, 30))))

        return score


def stands_out(toxic, ordinary, n_toxic: int, n_ordinary: int, share: float, times: float):
    """Of numbers of texts with a place, as Python numbers or columns: whether toxic text has it that much more often."""
    return (toxic >= max(4.0, share * n_toxic)) & (toxic * (n_ordinary / times) >= (ordinary + 1) * float(n_toxic))


def _spread(parts: list[bytes], most: int) -> list[bytes]:
    """At most so many of them, evenly spaced."""
    return parts if len(parts) <= most else [parts[k * len(parts) // most] for k in range(most)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with a place, by group, added up within a task as far as memory goes."""
    names, counts = ["place", "grp", "texts"], Counter()

    def flush() -> pa.RecordBatch:
        rows = [(p, g, k) for (p, g), k in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int32(), pa.int64()), strict=True)], names)

    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update({(p, group) for w in set(WORDS.findall(text.lower())) for p in places(w)})
            if len(counts) > 500_000:
                yield flush()
    yield flush()


def _samples(kept: list[set[str]]):
    """What each text gives to the dictionaries of its half (0 or 1) and of all (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller()
        for batch in batches:
            rows = []
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half, toxic = divmod(group, 2)
                if not toxic:
                    rows += [(half, 0, w) for w in _spread(speller.windows(text, 64, 64), PER_TEXT)]
                    continue
                words = WORDS.findall(text.lower())
                codes, begins = spell(words) if words else (np.zeros(0, "<u2"), np.zeros(1, int))
                for which in (half, 2):
                    keep = kept[which]
                    found = codes[np.fromiter((p in keep for w in words for p in places(w)), bool, len(codes))].tobytes()
                    rows += [(which, 1, p) for p in _spread([found[a : a + 128] for a in range(0, len(found), 128)], PER_TOXIC)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "toxic", "bytes"])

    return run


def _features(models: list[tuple[bytes, bytes]]):
    """Features of each text by the dictionaries of the other half and its number of windows; and, as class -1, how many ordinary windows have a distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, distances, ordinary = Speller(), [Distance(*m) for m in models], Counter()
        for batch in batches:
            rows = []
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = distances[1 - group // 2].of(speller.windows(text))
                rows.append((group % 2, *features(found), len(found)))
                if not group % 2:
                    ordinary.update(found.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, _FEATURES, strict=True)], ["toxic", "largest", "mean", "windows"])
        rows = [(-1, d, 0.0, n) for d, n in ordinary.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, _FEATURES, strict=True)], ["toxic", "largest", "mean", "windows"])

    return run


_FEATURES = (pa.int32(), pa.float64(), pa.float64(), pa.int64())


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, most: int = 2000, share: float = 0.01, times: float = 4.0, ordinary_size: int = 1 << 16, toxic_size: int = 1 << 12) -> Model:
    """Learn from at most `most` labelled rows of each class outside the held-out fold."""
    known = labels.where((common.fold("doc_id", modulus) != held) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", common.whole_text().alias("text"))
    ids = [known.where(F.col("toxic") == k).orderBy(rank, "doc_id").limit(most) for k in (0, 1)]
    drawn = [texts.join(F.broadcast(some), "doc_id").orderBy(rank, "doc_id", F.xxhash64("text")).limit(most) for some in ids]
    group = 2 * F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int") + F.col("toxic")
    sample = common.materialize(drawn[0].unionByName(drawn[1]).select(group.alias("grp"), "text").repartition(16), "labelled")
    used = {r["grp"]: r["count"] for r in sample.groupBy("grp").count().collect()}  # four rows
    n = np.array([[used.get(g, 0) for g in (0, 1)], [used.get(g, 0) for g in (2, 3)]])
    if n.sum() < 8 or not n.all():
        total = sum(counts.values())
        return Model(b"", b"", np.array([0.0, 0.0, counts.get(1, 0) / total if total else 0.0]))
    n = np.vstack([n, n.sum(0)])  # texts of either class in the halves, and in all
    by_place = sample.mapInArrow(_count, "place string, grp int, texts bigint").groupBy("place")
    sums: list[Column] = [F.sum(F.when(F.col("grp") == g, F.col("texts")).otherwise(0)).alias(f"g{g}") for g in range(4)]
    seen = [(F.col("g1"), F.col("g0")), (F.col("g3"), F.col("g2")), (F.col("g1") + F.col("g3"), F.col("g0") + F.col("g2"))]
    out = [stands_out(a, b, int(k[1]), int(k[0]), share, times).alias(f"out{i}") for i, ((a, b), k) in enumerate(zip(seen, n, strict=True))]
    rows = by_place.agg(*sums).select("place", *out).where("out0 or out1 or out2").collect()  # at most a few for each hundredth of the texts
    kept = [{r["place"] for r in rows if r[f"out{i}"]} for i in range(3)]
    parts = sample.mapInArrow(_samples(kept), "part int, toxic int, bytes binary").orderBy("part", "toxic", F.xxhash64("bytes"), "bytes").collect()

    def learn(part: int) -> tuple[bytes, bytes]:
        ordinary = [bytes(r["bytes"]) for r in parts if not r["toxic"] and part in (r["part"], 2)]
        toxic = [bytes(r["bytes"]) for r in parts if r["toxic"] and r["part"] == part]
        return train_dictionary(ordinary, ordinary_size), train_dictionary(toxic, toxic_size, k=32, d=8)

    # A row a text of the sample, and one for each distance in bytes that a task met.
    found = sample.mapInArrow(_features([learn(0), learn(1)]), "toxic int, largest double, mean double, windows bigint").toPandas()
    met, found = found[found["toxic"] < 0].groupby("largest")["windows"].sum(), found[found["toxic"] >= 0]
    tail = tail_of(met.index.to_numpy(float), met.to_numpy())
    found["largest"] -= tail * np.log(found["windows"].clip(lower=1))
    weights = calibrate(found[["largest", "mean"]].to_numpy(), found["toxic"].to_numpy(float))
    # The classes were drawn in other shares than they have.
    weights[-1] += np.log(counts[1] / counts[0]) - np.log(n[2, 1] / n[2, 0])
    return Model(*learn(2), weights, tail)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a column for the score."""
    docs = docs.drop(into)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = pa.array([of(t.as_py() or "") for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
