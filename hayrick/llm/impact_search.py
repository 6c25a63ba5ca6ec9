"""Exact top-k inner products by an impact-ordered index, score at a time.

Components are quantised to the integers floor(64 x). Vectors are dealt into blocks; a
block's index has for each dimension a posting list in descending order of component, cut
into segments of equal component. For a query the impact of a segment is its component
times the query's. Segments are taken up by descending impact, several quantised levels of
impact at a time, and added to accumulators. What a vector can still gain is known: each
of its postings not yet seen has at most the impact of the next level. Once the vectors whose bound
reaches the k-th best exact score are few, all others are proven out, the rest of the
postings is left, and the few are scored exactly. Nothing stops without that proof: if it
doesn't come, all postings are read. The k-th best score is carried from block to block.

Index and queries are tables: one row a posting list, one row for a few queries. Groups of
queries meet slabs of blocks in tasks; a task keeps its queries (QUERIES at most), their k
best and one block, whatever the size of the slab, and gives k rows a query, so the last
step ranks k times the number of slabs.

Odd input. Vectors that are null or have a null, infinite or NaN component take no part;
nor do those with a component beyond 2**27 after scaling, whose products don't fit a long.
Vectors of different lengths are compared as if zeros followed the shorter; an empty vector
scores 0. A row's own id excludes that row alone: other rows with the same id are
candidates, and repeated query rows are each a query. Rows with a null id are candidates, after all
others of the same score, and never queries. Ties go to the smaller id. An empty table
gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common

BLOCK = 8192  # vectors of a block, at most: a posting takes two bytes
CELLS = BLOCK * 64  # components of a block, at most
QUERIES = 16_384  # queries of a task
SLAB, LEAST_SLAB = 1 << 22, 1 << 16  # vectors of a slab at most, and those below which it isn't cut
LARGEST = 1 << 27
STOPS = (0.4, 0.5, 0.65, 1.0)  # shares of the postings after which proof is sought
FEW = 4  # scoring one row of so many exactly costs less than reading on
LEVELS = 64  # quantised levels of impact on either side of zero

_INDEX = "block bigint, kind int, size int, payload binary"
_FOUND = "query_key bigint, query_id bigint, vec_id bigint, score bigint"
HEADER, ASKED = -1, -2


def quantised(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column) -> DataFrame:
    """vec_id, is_query and v (integers) of the rows that take part."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * 64 < float(LARGEST)))  # NaN counts as largest
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.when(finite, x).alias("x"))
    return rows.where("x IS NOT NULL").select("vec_id", "is_query", F.transform("x", lambda c: F.floor(c.cast("double") * 64).cast("int")).alias("v"))


# ---------------------------------------------------------------- the index


def _lists(ids: np.ndarray, nulls: np.ndarray, asked: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The rows of one block: its header, the queries among its rows, a posting list for each dimension."""
    yield HEADER, len(ids), ids.tobytes() + nulls.tobytes()
    step = max(1, 2048 // max(1, x.shape[1]))
    places = np.flatnonzero(asked)
    for at in range(0, len(places), step):
        some = places[at : at + step].astype("<i4")
        yield ASKED, len(some), some.tobytes() + ids[some].tobytes() + x[some].tobytes()
    for d in range(x.shape[1]):
        order = np.argsort(-x[:, d], kind="stable")
        values = x[order, d]
        ends = np.append(np.flatnonzero(np.diff(values)) + 1, len(values)).astype("<i4")
        yield d, len(ends), values[ends - 1].tobytes() + ends.tobytes() + order.astype("<u2").tobytes()


def _build(parts: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        rows = width = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, width, made
            x = np.zeros((rows, width), "<i4")
            at = 0
            for _, _, _, lengths, values in held:
                inside = np.arange(width)[None, :] < lengths[:, None]
                x[at : at + len(lengths)][inside] = values
                at += len(lengths)
            lists = list(_lists(*(np.concatenate([h[k] for h in held]) for k in range(3)), x))
            block = part + parts * made
            held, rows, width, made = [], 0, 0, made + 1
            return pa.record_batch([pa.array([block] * len(lists), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*lists, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["block", "kind", "size", "payload"])

        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            ids = batch.column("vec_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy().astype("<i8")
            asked = batch.column("is_query").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                longest = np.maximum(np.maximum.accumulate(lengths[at:]), width)
                count = rows + np.arange(1, len(longest) + 1)
                fits = int(np.searchsorted((count > BLOCK) | (count * longest > CELLS), True))
                if not fits and not rows:
                    fits = 1
                if fits:
                    end = at + fits
                    values = column.slice(at, fits).flatten().to_numpy().astype("<i4")
                    held.append((plain[at:end], nulls[at:end], asked[at:end], lengths[at:end], values))
                    rows, width, at = rows + fits, int(longest[fits - 1]), end
                if at < len(lengths):
                    yield flush()
        if rows:
            yield flush()

    return build


def build_index(rows: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The stored index of quantised rows, and the number of tasks that wrote it; block numbers are mostly below that."""
    parts = max(1, -(-count // (BLOCK * 9 // 10)))
    return common.materialize(rows.repartition(parts).mapInArrow(_build(parts), _INDEX), "impacts"), parts


# ---------------------------------------------------------------- the search


class Block:
    """One block in memory: flat postings, their components, segments, and the vectors again."""

    def __init__(self, number: int, size: int, header: bytes, lists: list[tuple[int, bytes]]):
        self.number, self.size, self.width = number, size, len(lists)
        self.ids = np.frombuffer(header, "<i8", size)
        self.nulls = np.frombuffer(header, bool, size, 8 * size)
        self.x = np.zeros((size, self.width))
        self.places = np.empty(self.width * size, np.intp)
        self.parts = np.empty(self.width * size)
        values, lengths, dims = [], [], []
        for d, (n, payload) in enumerate(lists):
            v, ends = np.frombuffer(payload, "<i4", n), np.frombuffer(payload, "<i4", n, 4 * n)
            order, each = np.frombuffer(payload, "<u2", size, 8 * n), np.diff(ends, prepend=0)
            spread = np.repeat(v, each)
            self.x[order, d] = spread
            self.places[d * size : (d + 1) * size], self.parts[d * size : (d + 1) * size] = order, spread
            values.append(v), lengths.append(each), dims.append(np.full(n, d))
        self.values = np.concatenate(values or [np.zeros(0)]).astype(float)
        self.lengths = np.concatenate(lengths or [np.zeros(0, int)])
        self.dims = np.concatenate(dims or [np.zeros(0, int)])
        self.first = np.searchsorted(self.dims, np.arange(self.width))


    def wide(self) -> np.ndarray:
        return self.x.astype(np.int64)


class Asked:
    """A query and its best so far."""

    def __init__(self, key: int, vec_id: int, v: np.ndarray, k: int):
        self.key, self.vec_id, self.v, self.k = key, vec_id, v.astype(np.int64), k
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # scores, ids, null ids
        self.stop = 0  # the stop of the last block: the next one begins there
        self.read = 0  # postings read

    @property
    def least(self) -> float:
        return float(self.best[0][-1]) if len(self.best[0]) == self.k else -np.inf

    def offer(self, block: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        s, i, o = (np.concatenate(pair) for pair in zip(self.best, (scores, block.ids[rows], block.nulls[rows]), strict=True))
        order = np.lexsort((i, o, -s))[: self.k]
        self.best = (s[order], i[order], o[order])

    def search(self, block: Block) -> None:
        """Take up a block's segments by descending impact until all rows but a few are proven out; score those exactly."""
        width = min(block.width, len(self.v))
        v = np.zeros(block.width, np.int64)
        v[:width] = self.v[:width]
        own = self.key & 0xFFFF if self.key >> 16 == block.number else None
        weight = v.astype(float)
        impact = weight[block.dims] * block.values
        most = float(np.abs(impact).max(initial=0.0))
        small = most * block.width < 1 << 52  # then doubles are exact
        exact = lambda rows: (block.x[rows] @ weight).astype(np.int64) if small else (block.wide()[rows] * v).sum(axis=1)
        if not most or block.size <= 4 * self.k:
            rows = np.arange(block.size)
            self.offer(block, rows := rows[rows != own], exact(rows))
            return
        slack = 1e-12 * block.width * most  # of sums of doubles
        unit = most / LEVELS
        level = np.ceil(impact / unit).astype(np.int64) + LEVELS
        share = np.cumsum(np.bincount(level, block.lengths, 2 * LEVELS + 1)[::-1]) / (block.width * block.size)
        total, seen = np.zeros(block.size), np.zeros(block.size, np.int64)
        begun_low, begun_high = np.zeros(block.width, np.int64), np.zeros(block.width, np.int64)
        upward = weight >= 0
        # Where sums of impacts and a counter fit the 53 bits of a double, both share one.
        unit_of_sum = 1 << block.width.bit_length()
        packed = most * block.width * unit_of_sum < 1 << 52
        unit_of_sum = unit_of_sum if packed else 1
        starts = np.arange(block.width) * block.size
        for stop in range(self.stop, len(STOPS)):
            lowest = 2 * LEVELS - int(np.searchsorted(share, STOPS[stop] - 1e-9))  # levels from here up are taken
            taken = np.add.reduceat(np.where(level >= lowest, block.lengths, 0), block.first)
            # In each list what is taken is its beginning, or its end where the query's component is negative.
            low = starts + np.where(upward, begun_low, block.size - taken)
            high = starts + np.where(upward, taken, block.size - begun_high)
            begun_low = begun_high = taken
            pieces = [(d, a, b) for d, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) if b > a]
            if pieces:
                places = np.concatenate([block.places[a:b] for _, a, b in pieces])
                gains = np.empty(len(places))
                at = 0
                for d, a, b in pieces:
                    np.multiply(block.parts[a:b], weight[d] * unit_of_sum, out=gains[at : at + b - a])
                    at += b - a
                self.read += len(places)
                if packed:  # one pass adds impacts and counts postings
                    gains += 1.0
                    both = np.bincount(places, gains, block.size).astype(np.int64)
                    seen += both & (unit_of_sum - 1)
                    total += both >> unit_of_sum.bit_length() - 1
                else:
                    total += np.bincount(places, gains, block.size)
                    seen += np.bincount(places, minlength=block.size)
            gain = (lowest - 1 - LEVELS) * unit  # no posting that is left has a larger impact
            bound = total + (block.width - seen) * gain + slack
            if own is not None:
                bound[own] = -np.inf
            least = self.least
            if least == -np.inf:  # exact scores of the likeliest rows give a threshold
                likely = np.argpartition(-bound, 4 * self.k)[: 4 * self.k]
                scores = np.sort(exact(likely[likely != own]))
                least = float(scores[-self.k]) if len(scores) >= self.k else -np.inf
            rows = np.flatnonzero(bound >= least)
            if len(rows) <= max(4 * self.k, block.size // FEW):
                break
        self.stop = max(0, stop - 1) if len(rows) <= block.size // (4 * FEW) else stop
        rows = rows[rows != own] if own is not None else rows
        scores = exact(rows)
        keep = scores >= least
        self.offer(block, rows[keep], scores[keep])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, number, size, header, lists = None, [], None, 0, b"", []

        def finish() -> None:
            nonlocal lists, number
            if number is not None and asked:
                block = Block(number, size, header, lists)
                for one in asked:
                    one.search(block)
            lists, number = [], None

        def found() -> pa.RecordBatch:
            scores, ids, nulls = (np.concatenate([a.best[i] for a in asked]) for i in range(3))
            of = [len(a.best[0]) for a in asked]
            keys, own = (np.repeat(np.array([getattr(a, name) for a in asked], np.int64), of) for name in ("key", "vec_id"))
            return pa.record_batch([pa.array(keys), pa.array(own), pa.array(ids, mask=nulls), pa.array(scores)], ["query_key", "query_id", "vec_id", "score"])

        for batch in batches:
            for c, block, kind, n, payload in zip(*(batch.column(name).to_pylist() for name in ("cell", "block", "kind", "size", "payload")), strict=True):
                if c != cell:
                    finish()
                    if asked:
                        yield found()
                    cell, asked = c, []
                if kind == ASKED:
                    places, ids = np.frombuffer(payload, "<i4", n), np.frombuffer(payload, "<i8", n, 4 * n)
                    vectors = np.frombuffer(payload, "<i4", -1, 12 * n).reshape(n, -1)
                    asked += [Asked(block << 16 | int(p), int(i), v, k) for p, i, v in zip(places, ids, vectors, strict=True)]
                elif kind == HEADER:
                    finish()
                    number, size, header = block, n, payload
                else:
                    lists.append((n, payload))
        finish()
        if asked:
            yield found()

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_column, vector_column, is_query)
    count, queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    index, parts = build_index(rows, count)
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Lists are sent once a group and queries once a slab; both together are least where they send
    # alike. A threshold serves all blocks of a slab, so small slabs aren't worth their saving.
    alike = math.isqrt(want * count // max(1, queries))
    slabs = max(1, min(parts, max(-(-count // SLAB), min(alike, count // LEAST_SLAB))))
    groups = max(1, -(-queries // QUERIES), min(-(-want // slabs), queries // 64))
    # Queries go to every slab, lists to every group: blocks of either, never single pairs.
    asked = index.where(F.col("kind") == ASKED).select(F.pmod(F.xxhash64("block", "payload"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), "*")
    lists = index.where(F.col("kind") != ASKED).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"), F.pmod("block", F.lit(slabs)).cast("int").alias("slab"), "*")
    cells = asked.unionByName(lists).select((F.col("group") * slabs + F.col("slab")).alias("cell"), "block", "kind", "size", "payload")
    dealt = cells.repartitionByRange(groups * slabs, "cell").sortWithinPartitions("cell", F.col("kind") != ASKED, "block", "kind")
    found = dealt.mapInArrow(_search(k), _FOUND)
    order = "row_number() OVER (PARTITION BY query_key ORDER BY score DESC, vec_id ASC NULLS LAST)"
    ranked = found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q AS a JOIN q AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
