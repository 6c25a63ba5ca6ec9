"""Packing documents into token sequences by vector best fit.

Every piece asks for three resources of a sequence: tokens, one of its document slots,
and attention cost (the square of its length). Pieces go longest first; each takes, of
the open sequences where all three still fit, the one with the smallest weighted norm of
what would be left (rule "norm") or the largest weighted dot product of its needs with
what is left (rule "dot"); where none fits a new one is opened. Shares of the capacities are
weighted so that tokens count most, which keeps the number of sequences close to total
tokens / capacity.

A sequence must have room for a full piece, so with the attention capacity of `pack`, the
square of the tokens, attention cost can't run out before tokens do and only steers the
choice; a smaller one, for pieces that are all shorter, does. So it is with the slots: every
piece has a token at least, and fewer slots than tokens are for callers who want them.

Only documents longer than a sequence are cut: whole sequences from their end, so the
first piece may be shorter and is packed with the others; the whole ones need no search.
Shorter pieces are dealt by hash into groups of about `group_rows`, packed each by one
task: at most one sequence of a group or so stays part empty.

Defined cases: null text is the empty text (the end id alone); a null doc_id is kept;
repeated rows are packed each on its own; an empty table gives no rows; other columns
are ignored. Attention capacity and document slots that a piece alone exceeds raise
ValueError when the capacities are set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common
from hayrick.llm.tokens import Encoder, tokenizer_path

END_ID = 0
CAPACITY = 2048
#: Document slots of a sequence (as many as tokens: by default slots can't run out before tokens do), and how much tokens, slots and attention cost count in a norm or product.
DOCUMENTS, WEIGHTS = CAPACITY, (1.0, 0.05, 0.05)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def vector_best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: int, *, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its offset there."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    if documents < 1 or attention < capacity * capacity and len(lengths) and attention < int(lengths.max()) ** 2:
        raise ValueError("a single piece exceeds the capacities")
    n, scale = len(lengths), np.array([capacity, documents, attention], float)
    w = np.asarray(weights) / scale**2
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, max(n, 1)))  # of the bins that may still take something
    names = np.empty(max(n, 1), np.int64)
    live = total = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if n else 0
    for i in order:
        t = float(lengths[i])
        need = np.array([t, 1.0, t * t])
        rest = left[:, :live]
        fits = np.flatnonzero((rest[0] >= t) & (rest[1] >= 1) & (rest[2] >= t * t))
        if len(fits):
            some = rest[:, fits]
            score = (w[:, None] * (some - need[:, None]) ** 2).sum(0) if rule == "norm" else -(w[:, None] * some * need[:, None]).sum(0)
            k = int(fits[np.argmin(score)])
        else:
            k = live
            left[:, k], names[k] = scale, total
            live, total = live + 1, total + 1
        bins[i], offsets[i] = names[k], capacity - left[0, k]
        left[:, k] -= need
        if left[0, k] < smallest or left[1, k] < 1:
            live -= 1
            left[:, k], names[k] = left[:, live], names[live]
    return bins, offsets


def _pieces(path: str, end: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b, _, _ in common.text_slices(texts, 4 << 20):
                ids, at = encoder.encode(texts.slice(a, b - a), end)
                ids = ids.astype("<u4")
                rows = []
                for k in range(b - a):
                    first, last = int(at[k]), int(at[k + 1])
                    cuts = [first, *range(first + ((last - first) % capacity or capacity), last + 1, capacity)]
                    rows += [(names[a + k], p, x - first, y - x, zlib.crc32(ids[x:y])) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pack(docs: DataFrame, path: str, *, end: int = END_ID, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: int = CAPACITY * CAPACITY, rule: str = "norm", group_rows: int = 4096) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, math.ceil(docs.count() / group_rows))
    texts = docs.select(F.col("doc_id").cast("bigint"), common.whole_text().alias("text"))
    pieces = common.materialize(texts.mapInArrow(_pieces(path, end, capacity), PIECES), "pieces")
    full = F.col("length") == capacity
    keyed = pieces.where(~full).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)).cast("int"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = vector_best_fit(rows["length"].to_numpy(np.int64), capacity, documents, attention, rule=rule)
        return rows.assign(sequence_id=rows["bucket"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns="bucket")

    packed = keyed.groupBy("bucket").applyInPandas(fit, PIECES + ", sequence_id bigint, offset bigint")
    # A full piece is a sequence of its own; its number is negative and unlike any group's.
    alone = pieces.where(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(alone)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
