"""Exact integer k-means by partial-distance search.

Vectors are quantised to the integers floor(64 x). A round is one pass over the stored vectors: every
batch assigns its vectors and gives its clusters' counts and sums, Spark adds those up, and
the driver holds nothing but the centroids. The assignment accumulates squared differences
dimension by dimension, those of high variance first, a few at a time. A vector begins with
the distance to its likeliest centroid, and gives up each other one once the sum is strictly above
its best so far; what survives finishes all dimensions, so that distances are exact and ties go to the
smaller number.

Odd input. Vectors that are null, have another number of components, or have a null, infinite
or NaN one aren't kept; nor are those with a component beyond 2**27 after scaling, whose
squared distances don't fit a long. Vectors with a null id are clustered like others but can't be
initial centroids unless there are too few with an id; they hash as "1:". Repeated rows are each
a vector, and each may be an initial centroid; with fewer kept vectors than clusters there are
as many centroids as vectors. Empty clusters keep their centroid. An empty table gives no rows. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common

LARGEST = 1 << 27
STRIDE = 8  # dimensions between two looks at who gives up
ROWS = 4096  # vectors that are assigned at once

_SUMS = "cluster int, n bigint, sums array<bigint>"
_ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def quantised(vectors: DataFrame, width: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v (integers) of the rows that are kept."""
    x = F.col(vector_column)
    finite = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * 64 < float(LARGEST)))  # NaN counts as largest
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.when(finite, x).alias("x")).where("x IS NOT NULL")
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * 64).cast("int")).alias("v"))


def by_variance(rows: DataFrame, width: int) -> np.ndarray:
    """Dimensions by descending variance: two sums a dimension reach the driver."""
    v = [F.col("v")[d].cast("double") for d in range(width)]
    spread = rows.agg(*(F.var_pop(c) for c in v)).first()
    return np.argsort([-(s or 0.0) for s in spread], kind="stable")


def assign(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of x, the squared distance, and how many squared differences that took."""
    n, c = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    rows, width, head = len(n), n.shape[1], min(STRIDE, n.shape[1])
    part = np.empty((len(c), rows), np.int64)  # of the first dimensions, for all: it names the likeliest
    for k in range(len(c)):
        part[k] = ((n[:, :head] - c[k, :head]) ** 2).sum(axis=1)
    cluster = part.argmin(axis=0)
    best = part.min(axis=0) + ((n[:, head:] - c[cluster, head:]) ** 2).sum(axis=1)
    work = rows * (len(c) * head + width - head)
    first = cluster.copy()
    for k in range(len(c)):
        alive = np.flatnonzero((part[k] <= best) & (first != k))
        total = part[k, alive]
        for at in range(head, width, STRIDE):
            if not len(alive):
                break
            step = n[alive, at : at + STRIDE] - c[k, at : at + STRIDE]
            total = total + np.einsum("ij,ij->i", step, step)
            work += step.size
            stays = total <= best[alive]
            alive, total = alive[stays], total[stays]
        wins = (total < best[alive]) | (k < cluster[alive])
        alive, total = alive[wins], total[wins]
        best[alive], cluster[alive] = total, k
    return cluster.astype(np.int32), best, work


def _vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some.column("vec_id"), some.column("v").flatten().to_numpy().reshape(-1, width)


def _sums(centroids: np.ndarray, order: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in _vectors(batches, centroids.shape[1]):
            cluster, _, _ = assign(x, centroids, order)
            for k in np.unique(cluster).tolist():
                mine = x[cluster == k]
                count[k] += len(mine)
                total[k] += mine.sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return sums


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, centroids.shape[1]):
            cluster, distance, _ = assign(x, centroids, order)
            yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return assigned


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = common.materialize(quantised(vectors, width, id_column, vector_column), "quantised")
    order = by_variance(rows, width)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(F.col("vec_id").isNull(), key, "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, width)
    for _ in range(rounds if len(first) else 0):
        # Sums of batches are longs; over all of them they may not be.
        total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
        for r in rows.mapInArrow(_sums(centroids, order), _SUMS).groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
            centroids[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    if not len(first):
        found = spark.createDataFrame([], _ASSIGNED)
    else:
        found = common.materialize(rows.mapInArrow(_assigned(centroids, order), _ASSIGNED), "assigned")
    stats = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a cluster
    whole = sum(int(r["s"]) for r in stats)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(r["cluster"], int(r["s"]), whole, digest[r["cluster"]]) for r in stats], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3, clusters: int = 16) -> str:
    """The rounds as one common table each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, [d, c]) AS c, min(d) AS d FROM ("
            f"SELECT p.vec_id, m.c, sum((p.v - m.v) * (p.v - m.v)) AS d FROM p JOIN m{r} AS m USING (i) GROUP BY ALL) GROUP BY vec_id)"
        )
        if r < rounds:
            steps.append(
                f"m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(n.v, m.v) AS v FROM m{r} AS m LEFT JOIN ("
                f"SELECT a{r}.c, p.i, floor(sum(p.v)::DOUBLE / count(*))::BIGINT AS v FROM a{r} JOIN p USING (vec_id) GROUP BY ALL) AS n USING (c, i))"
            )
    joined = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS i, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept),
begin AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {clusters}),
m0 AS MATERIALIZED (SELECT c, i, v FROM begin JOIN p USING (vec_id)),
{joined},
named AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c)
"""


OP13_SQL = _sql()
