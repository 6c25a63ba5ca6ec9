"""Quality classification by co-training.

Two logistic regressions see a document from two sides: its words and characters (text
view), and what is known about its page (language, source, the length that the table states,
and the layout of its lines: metadata view). The layout is there because language, source
and length alone say nothing of quality in the given tables (each value of them has the same
share of good labels), and a view without any signal can teach the other nothing. They start from the labelled sample. In each round either view labels the unlabelled
documents it is surest of, as many of each class as the class's share asks for, and hands
them to the other view, which learns from them too. Then both views are calibrated on
labelled rows that neither has learned from, and the calibrated log odds are added up by a
logistic regression on the same rows. That model scores every document.

Features are computed inside tasks, vectorised over batches, and kept in the shared folder
while learning. Every round scores all unlabelled documents in tasks; the surest of each
view and class, `each` a view at most, come to the driver, so it holds no more than
rounds * each pseudo-labels a view. Means and deviations are aggregates over all documents
outside the held-out fold. Labelled documents are a sample: at most `most`, those with the
smallest hash of their id. Nothing is learned from the held-out fold.

Defined cases: null texts are empty; empty texts have features of length 0; very long texts
are read whole; null language, source or n_chars count as a value of their own; repeated rows score alike; an empty table gives no rows; without
labels of both classes every score is the share of good labels (1 without any); a column
named like a result is replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from hayrick.llm import common

WORD_BINS, NAME_BINS = 128, 32
_CLASS = np.full(256, 7, np.int8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark, 7 beyond ASCII
_CLASS[32:127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\""]] = 5
_CLASS[[*range(9), *range(14, 32), 127]] = 6


def _bin(name: str | None) -> int:
    return xxhash.xxh3_64_intdigest((name or "\0").encode()) % NAME_BINS


def views(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of the rows of text, lang, source and n_chars."""
    n = batch.num_rows
    text = np.zeros((n, 8 + 5 + WORD_BINS))
    meta = np.zeros((n, 2 * NAME_BINS + 6))
    given = batch.column(batch.schema.get_field_index("n_chars"))
    known = np.array([v is not None for v in given.to_pylist()], bool)
    chars = np.array([max(v or 0, 0) for v in given.to_pylist()], float)
    column = batch.column(batch.schema.get_field_index("text"))
    for first, end, data, offsets in common.text_slices(column.fill_null("")):
        rows, size = np.arange(first, end), np.diff(offsets)
        words, at = common.hash_words(data, offsets)
        kinds = _CLASS[data[offsets[0] : offsets[-1]]]
        row = np.repeat(np.arange(end - first), size)
        by_kind = np.bincount(row * 8 + kinds, minlength=(end - first) * 8).reshape(-1, 8)
        count = np.diff(at)
        owner = np.repeat(np.arange(end - first), count)
        bins = np.bincount(owner * WORD_BINS + (words % np.uint64(WORD_BINS)).astype(np.int64), minlength=(end - first) * WORD_BINS).reshape(-1, WORD_BINS)
        distinct = np.bincount(np.unique(np.column_stack([owner.astype(np.uint64), words]), axis=0)[:, 0].astype(np.int64), minlength=end - first) if len(words) else np.zeros(end - first)
        some = np.maximum(count, 1)
        text[rows, :8] = by_kind / np.maximum(size, 1)[:, None]
        text[rows, 8] = distinct / some
        text[rows, 9] = np.log1p(size / some)
        text[rows, 10] = np.minimum(by_kind[:, 6] / some, 3)  # marks a word
        text[rows, 11] = np.minimum(by_kind[:, 1] / some, 3)  # capitals a word
        text[rows, 12] = np.log1p(count)
        text[rows, 13:] = np.sqrt(bins / some[:, None])
        lines = np.maximum(by_kind[:, 4] + (size > 0), 1)
        meta[rows, 2 * NAME_BINS + 2] = np.log1p(lines)
        meta[rows, 2 * NAME_BINS + 3] = np.log1p(chars[rows] / lines)
        meta[rows, 2 * NAME_BINS + 4] = np.log1p(by_kind[:, 5] / lines)
        meta[rows, 2 * NAME_BINS + 5] = by_kind[:, 4] / some
    meta[:, 2 * NAME_BINS] = np.log1p(chars)
    meta[:, 2 * NAME_BINS + 1] = ~known
    for k, name in enumerate(("lang", "source")):
        values = batch.column(batch.schema.get_field_index(name)).to_pylist()
        meta[np.arange(n), k * NAME_BINS + np.array([_bin(v) for v in values], np.int64)] = 1
    return text, meta


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(a.shape[1]), np.full(a.shape[1], ridge * len(x))
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -15, 15)


class Model:
    def __init__(self, share: float, weights: list[np.ndarray] | None = None, centre: list[tuple[np.ndarray, np.ndarray]] | None = None, calibration: list[np.ndarray] | None = None, joint: np.ndarray | None = None):
        self.share, self.weights, self.centre, self.calibration, self.joint = share, weights, centre, calibration, joint

    def calibrated(self, both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Calibrated log odds of the two views."""
        parts = zip(both, self.weights, self.centre, self.calibration, strict=True)
        return np.column_stack([odds(odds((x - m) / s, w)[:, None], c) for x, w, (m, s), c in parts])

    def scores(self, both: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, metadata and joint score."""
        n = len(both[0])
        if self.weights is None:
            return (np.full(n, self.share),) * 3
        z = self.calibrated(both)
        sigmoid = lambda v: 1 / (1 + np.exp(-v))
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(odds(z, self.joint))


COLUMNS = ("text", "lang", "source", "n_chars")
VIEWS = ("text_view", "meta_view")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(n, -1)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, key (of id and text) and both views of all rows, written once."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), common.whole_text().alias("text"), "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * v.shape[1], v.astype(np.float32).ravel()) for v in views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "key", *VIEWS])

    fields = [rows.schema["doc_id"], StructField("key", LongType()), *(StructField(v, ArrayType(FloatType())) for v in VIEWS)]
    return common.materialize(rows.mapInArrow(run, StructType(fields)), "features")


def centres(features: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of both views over all rows, from one sum a feature and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([_matrix(c, batch.num_rows) for c in batch.columns])
            k = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, len(x))), pa.array(x.sum(0)), pa.array((x * x).sum(0))], ["k", "n", "s", "q"])

    sums = features.select(*VIEWS).mapInArrow(run, "k bigint, n bigint, s double, q double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "nsq"])
    rows = sorted(sums.collect())  # one a feature
    n, s, q = (np.array([r[c] for r in rows], float) for c in "nsq")
    # Sums depend on their order in the last bits; means and deviations shouldn't.
    mean, deviation = np.round(s / n, 9), np.round(np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)), 6) + 1e-6
    width = 13 + WORD_BINS
    return [(mean[:width], deviation[:width]), (mean[width:], deviation[width:])]


def surest(features: DataFrame, known: DataFrame, weights: list[np.ndarray], centre: list[tuple[np.ndarray, np.ndarray]], taken: list[list[int]], quota: tuple[int, int], sure: float) -> list:
    """For each view and label the keys of the `quota[label]` surest rows that have no label and aren't in taken[view]."""
    shared = features.sparkSession.sparkContext.broadcast((weights, centre, [np.array(t, np.int64) for t in taken]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centre, taken = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(1))
            for v in (0, 1):
                m, s = centre[v]
                z = odds((_matrix(batch.column(2 + v), len(key)) - m) / s, weights[v])
                p = 1 / (1 + np.exp(-z))
                for label, q in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero((q >= sure) & ~np.isin(key, taken[v]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key[at]), pa.array(np.full(len(at), 2 * v + label, np.int32)), pa.array(q[at])], ["doc_id", "key", "slot", "q"])

    fields = StructType([features.schema["doc_id"], StructField("key", LongType()), StructField("slot", IntegerType()), StructField("q", DoubleType())])
    found = features.select("doc_id", "key", *VIEWS).mapInArrow(run, fields).join(known.select("doc_id"), "doc_id", "left_anti")
    # The window stops at the quota in every task before rows are dealt by slot.
    order = Window.partitionBy("slot").orderBy(F.desc("q"), F.xxhash64(F.col("doc_id").cast("string")), "key")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(quota))
    best = best.where(F.col("rank") <= F.when(F.col("slot") % 2 == 1, quota[1]).otherwise(quota[0]))
    return best.orderBy("slot", "rank").select("slot", "key").collect()


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, most: int = 3000, rounds: int = 4, each: int = 100, sure: float = 0.9) -> Model:
    outside = common.fold("doc_id", modulus) != held
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    # Ids are drawn first, so that no text is shuffled; at most `most` of them are broadcast.
    some = known.where(outside).orderBy(rank, "doc_id").limit(most)
    counts = {r["quality"]: r["count"] for r in some.groupBy("quality").count().collect()}  # two rows
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    if sum(counts.values()) < 12 or len(counts) < 2:
        return Model(share)
    features = featured(docs.where(outside))
    # Features of the sample come to the driver, no texts.
    sample = features.join(F.broadcast(some), "doc_id").orderBy(rank, "doc_id", "key").limit(most).select("quality", *VIEWS).toArrow()
    y = np.array(sample.column("quality").to_pylist(), int)
    if len(y) < 12 or not 0 < y.sum() < len(y):
        return Model(share)
    labelled = tuple(_matrix(sample.column(v).combine_chunks(), len(y)) for v in VIEWS)
    kept = np.arange(len(y)) % 3 == 2  # for calibration
    if not 0 < y[kept].sum() < kept.sum() or not 0 < y[~kept].sum() < (~kept).sum():
        kept = np.zeros(len(y), bool)
    centre = centres(features)
    scaled = lambda views: [(v - m) / s for v, (m, s) in zip(views, centre, strict=True)]
    ready = scaled(labelled)
    given: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]  # pseudo-labels and features handed to each view
    weights = [np.zeros(0)] * 2
    quota = (max(1, round(each * (1 - share))), max(1, round(each * share)))
    for turn in range(rounds + 1):
        for v in (0, 1):
            x = np.vstack([ready[v][~kept], *(x[None] for _, x in given[v].values())])
            weights[v] = logistic(x, np.concatenate([y[~kept], [label for label, _ in given[v].values()]]).astype(float))
        if turn == rounds:
            break
        chosen = surest(features, known, weights, centre, [list(given[1]), list(given[0])], quota, sure)
        if not chosen:
            break
        fetched = features.where(F.col("key").isin(sorted({r["key"] for r in chosen}))).dropDuplicates(["key"]).select("key", *VIEWS).collect()
        found = {r["key"]: scaled([np.array(r[v], float)[None] for v in VIEWS]) for r in fetched}
        for r in chosen:
            to = 1 - r["slot"] // 2
            given[to][r["key"]] = (r["slot"] % 2, found[r["key"]][to][0])
    held_rows = kept if kept.any() else np.ones(len(y), bool)
    calibration = [logistic(odds(ready[v][held_rows], weights[v])[:, None], y[held_rows].astype(float)) for v in (0, 1)]
    model = Model(share, weights, centre, calibration)
    model.joint = logistic(model.calibrated(tuple(x[held_rows] for x in labelled)), y[held_rows].astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with text_score, meta_score and score (of being good)."""
    names = ["text_score", "meta_score", "score"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(views(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", *COLUMNS)
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
