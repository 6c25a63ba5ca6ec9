"""Exact nearest neighbours of a stated set of query vectors.

Up to `block` queries are broadcast. More are dealt into groups that meet slabs of rows, all in
tasks. Each task keeps the k best of its rows for every query, so that only (slabs x queries x k)
rows are ranked, not a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


SLAB = 1 << 16  # rows that meet a group of queries in one task


class _Best:
    """The k best rows of each of some queries, from one stretch of rows after another."""

    def __init__(self, names: np.ndarray, targets: np.ndarray, k: int):
        self.names, self.targets, self.k = names, targets, k
        self.distances, self.ids = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), 1024):
            part = vectors[at : at + 1024]
            if len(self.names) * part.size <= 1 << 24:
                d = np.sqrt(np.maximum(((self.targets[:, None, :] - part[None]) ** 2).sum(2), 0))
            else:
                d = np.stack([np.sqrt(((part - t) ** 2).sum(1)) for t in self.targets])
            distances = np.concatenate([self.distances, d], 1)
            known = np.concatenate([self.ids, np.broadcast_to(ids[at : at + 1024], d.shape)], 1)
            order = np.lexsort((known, np.round(distances, 9)), axis=1)[:, : self.k]
            self.distances, self.ids = np.take_along_axis(distances, order, 1), np.take_along_axis(known, order, 1)

    def rows(self) -> list[pa.Array]:
        return [pa.array(np.repeat(self.names, self.ids.shape[1])), pa.array(self.ids.ravel()), pa.array(self.distances.ravel())]


_FOUND = "qid bigint, id bigint, distance double"
_NAMES = ["qid", "id", "distance"]


def _to_few(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All queries go to where the rows are."""
    some = queries.collect()  # no more than a block
    names, targets = np.array([r["qid"] for r in some], np.int64), np.array([r["v"] for r in some], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((names, targets))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        for batch in batches:
            best.offer(batch.column(0).to_numpy(), _vectors(batch.column(1)))
        if best.ids.shape[1]:
            yield pa.RecordBatch.from_arrays(best.rows(), _NAMES)

    return rows.mapInArrow(nearest, _FOUND)


def _in_cells(queries: DataFrame, rows: DataFrame, k: int, groups: int, slabs: int) -> DataFrame:
    """Groups of queries meet slabs of rows, each pair of them in one task; nothing passes through the driver."""
    asked = queries.select(F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slabs - 1).cast("bigint"))).alias("slab"), "qid", "v")
    there = rows.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("grp"), F.pmod(F.xxhash64("id"), F.lit(slabs)).alias("slab"), "id", "v")

    def nearest(some: pa.Table, part: pa.Table) -> pa.Table:
        if not some.num_rows or not part.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], _NAMES)
        best = _Best(some.column("qid").to_numpy(), _vectors(some.column("v").combine_chunks()), k)
        best.offer(part.column("id").to_numpy(), _vectors(part.column("v").combine_chunks()))
        return pa.table(best.rows(), _NAMES)

    return asked.groupBy("grp", "slab").cogroup(there.groupBy("grp", "slab")).applyInArrow(nearest, _FOUND)


def knn(queries: DataFrame, rows: DataFrame, k: int, *, query_id: str = "qid", id_column: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """qid, id, distance (Euclidean) and rank of the k nearest rows of every query; ties go to the smaller id.

    Rows and queries without a vector are left out.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("bigint").alias("qid"), F.col(vector).alias("v"))
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n = asked.count()
    if not n:
        found = rows.sparkSession.createDataFrame([], _FOUND)
    elif n <= block:
        found = _to_few(asked, rows, k)
    else:
        found = _in_cells(asked, rows, k, -(-n // block), max(1, -(-rows.count() // SLAB)))
    order = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
