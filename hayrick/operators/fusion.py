"""Fusing rankings, widening the pool, ordering candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def fuse(rankings: DataFrame, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion. rankings: qid, list_no, rank (from 1), id. Ties keep the order of first appearance over the lists."""
    seen = F.col("list_no").cast("bigint") * F.lit(1_000_000_000) + F.col("rank")
    fused = rankings.groupBy("qid", "id").agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"), F.min(seen).alias("first_seen"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "first_seen")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def best_files(pool: DataFrame) -> DataFrame:
    """qid, path, file_rank: files of pooled candidates by their best score; scores of 0 or less count for nothing."""
    best = pool.where(F.col("score") > 0).groupBy("qid", "path").agg(F.max("score").alias("best"), F.min("rank").alias("first"))
    return best.withColumn("file_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("best", 12).desc(), "first")))


def expand_pool(pool: DataFrame, symbols: DataFrame, *, per_file: int = 3, most: int = 50, pooled: int = 50) -> DataFrame:
    """Siblings of pooled candidates: per file the best by term hits, then cosine, then id; files in the order of their best candidate.

    pool: qid, id, path, score, rank. symbols: id, path, and per query hits and cosine
    (or without qid, the same for all). The cap holds for each query. Without qid, files are
    cut to their first per_file + `pooled` symbols before queries come in: a query's pool has
    no more than `pooled` symbols that could be passed over.
    """
    keys = ["qid", "path"] if "qid" in symbols.columns else ["path"]
    if "qid" not in symbols.columns:
        first = Window.partitionBy("path").orderBy(F.col("hits").desc(), F.round("cosine", 9).desc(), "id")
        symbols = symbols.withColumn("in_file", F.row_number().over(first)).where(F.col("in_file") <= per_file + pooled).drop("in_file")
    siblings = symbols.join(best_files(pool), keys).join(pool.select("qid", "id"), ["qid", "id"], "left_anti")
    in_file = Window.partitionBy("qid", "path").orderBy(F.col("hits").desc(), F.round("cosine", 9).desc(), "id")
    kept = siblings.withColumn("in_file", F.row_number().over(in_file)).where(F.col("in_file") <= per_file)
    overall = Window.partitionBy("qid").orderBy("file_rank", "in_file")
    return kept.withColumn("position", F.row_number().over(overall)).where(F.col("position") <= most)


def reorder(candidates: DataFrame, score: Column, position: str = "rank") -> DataFrame:
    """A stable sort of each query's candidates by score, as new_rank."""
    order = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), position)
    return candidates.withColumn("new_rank", F.row_number().over(order))


def prefer_production(candidates: DataFrame, prior: float = 0.01) -> DataFrame:
    """Production code moves ahead of nearly equal other code; scores stay."""
    return reorder(candidates, F.col("score") + F.when(F.col("source_role") == "production", prior).otherwise(0.0))


def valid_orders(replies: DataFrame, pool_sizes: DataFrame) -> DataFrame:
    """qid and valid: a reranker's reply counts if it names every candidate once, with a finite score.

    replies: qid, idx (from 0), score, response_pos. pool_sizes: qid, size.
    """
    good = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    checked = replies.join(pool_sizes, "qid", "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("idx").alias("distinct_idx"),
        F.min((good & (F.col("idx") >= 0) & (F.col("idx") < F.col("size"))).cast("int")).alias("fine"),
        F.max("size").alias("size"),
    )
    return pool_sizes.join(checked.drop("size"), "qid", "left").select("qid", F.coalesce((F.col("n") == F.col("size")) & (F.col("distinct_idx") == F.col("size")) & (F.col("fine") == 1), F.lit(False)).alias("valid"))


def apply_rerank(pool: DataFrame, replies: DataFrame, valid: DataFrame, fallback: Column) -> DataFrame:
    """New scores and order where the reply is valid, the fallback score's order elsewhere. pool: qid, id, rank (from 1), score."""
    scored = pool.join(replies.select("qid", (F.col("idx") + 1).alias("rank"), F.col("score").alias("reply"), "response_pos"), ["qid", "rank"], "left").join(valid, "qid")
    final = F.when(F.col("valid"), F.col("reply")).otherwise(fallback)
    scored = scored.withColumn("final", final).withColumn("tie", F.when(F.col("valid"), F.col("response_pos")).otherwise(F.col("rank")))
    return reorder(scored, F.col("final"), "tie")
