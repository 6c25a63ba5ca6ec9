"""Retrieval quality: ranks, losses and summary figures over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.sources import scratch


def case_ranks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case the rank of its gold symbol and of its gold file; null where it isn't found.

    results: qid, rank, id, path. gold: qid, gold_id, gold_path.
    """
    joined = gold.join(results, "qid", "left")
    return joined.groupBy("qid").agg(F.min(F.when(F.col("id") == F.col("gold_id"), F.col("rank"))).alias("rank"), F.min(F.when(F.col("path") == F.col("gold_path"), F.col("rank"))).alias("path_rank"))


def loss_stage(rank: Column, in_pool: Column, in_lists: Column, k: int) -> Column:
    """Where a case lost its gold symbol; null if it is among the first k."""
    return F.when(rank <= k, None).when(in_pool & rank.isNull(), "not_fetched").when(in_pool, "ranked_deep").when(in_lists, "pool_cutoff").otherwise("not_retrieved")


def replay_loss_stage(rank: Column, k: int) -> Column:
    return F.when(rank <= k, None).when(rank.isNull(), "pool_absent").otherwise("ranked_deep")


def retrieved_by(lexical: Column, dense: Column, expansion: Column) -> Column:
    return F.array_compact(F.array(F.when(lexical, "fts"), F.when(dense, "dense"), F.when(expansion, "expansion")))


def _in_ranges(rows: DataFrame, column: str, each: int | None) -> DataFrame:
    """rows with `bucket`: the number of their range of the column, ascending, nulls in the first. Written out, so that every use sees the same ranges.

    There are as many ranges as the session has shuffle partitions, or as it takes for about `each` rows.
    """
    dealt = rows.repartitionByRange(column) if each is None else rows.repartitionByRange(max(1, -(-rows.count() // each)), column)
    return scratch.written(dealt.withColumn("bucket", F.spark_partition_id()), "ranges")


def percentiles(rows: DataFrame, group: list[str], column: str, fractions: dict[str, float], each: int | None = None) -> DataFrame:
    """Per group a column for each of `fractions`, by nearest rank; null for a group without values.

    Equal values are counted first. Only ranges of values that hold a rank are sorted, each in its own task.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = _in_ranges(counts, "value", each)
    sums = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))  # one row a range
    whole = Window.partitionBy(*group)
    sums = sums.withColumns({"before": F.sum("n").over(whole.orderBy("bucket")) - F.col("n"), "total": F.sum("n").over(whole)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(f)).cast("bigint")).alias("at")) for name, f in fractions.items()]))
    asked = sums.withColumn("asked", wanted).where((F.col("asked.at") > F.col("before")) & (F.col("asked.at") <= F.col("before") + F.col("n")))
    asked = asked.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col("bucket").alias("of_bucket"), F.col("asked.name").alias("name"), (F.col("asked.at") - F.col("before")).alias("at"))
    same = F.col("bucket") == F.col("of_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    inside = counts.join(asked, same)
    order = Window.partitionBy(*group, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("reached", F.sum("n").over(order)).where(F.col("reached") >= F.col("at"))
    found = reached.groupBy(*group).agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
    groups = rows.select(*group).distinct() if group else rows.sparkSession.range(1).select()
    if not group:
        return groups.join(found, how="left")
    known = found.select(*[F.col(g).alias(f"of_{g}") for g in group], *fractions)
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return groups.join(known, same, "left").select(*group, *fractions)


def row_ranks(rows: DataFrame, group: list[str], column: str, each: int | None = None) -> DataFrame:
    """rows with `rank`: their number by the column within the group, summed up over ranges of the column."""
    rows = _in_ranges(rows, column, each)
    sums = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("in_range"))  # one row a range
    sums = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("in_range"))
    numbered = rows.withColumn("inner", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(column)))
    return numbered.join(sums.drop("in_range"), [*group, "bucket"]).withColumn("rank", (F.col("inner") + F.col("before")).cast("int")).drop("bucket", "inner", "before")


def summary(cases: DataFrame, k: int) -> DataFrame:
    """One row over all cases: recall, mean reciprocal rank and file presence at k, latencies, cases with warnings."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    file = F.coalesce(F.col("path_rank") <= k, F.lit(False))
    latencies = percentiles(cases, [], "latency", {"p50": 0.5, "p95": 0.95})
    found = cases.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(file, 1.0).otherwise(0.0)).alias("file_presence"),
        F.sum("latency").alias("total_seconds"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"),
    )
    columns = ["n_cases", "recall", "mrr", "file_presence", "total_seconds", "p50", "p95", "with_warnings"]
    return found.crossJoin(F.broadcast(latencies)).select(*columns)


def yes_no_score(entries: Column) -> Column:
    """Probability of yes against no from array<struct<token, logprob>>; a missing one has the least of all; null without either."""
    first = lambda token: F.try_element_at(F.filter(entries, lambda e: e["token"] == token), F.lit(1))["logprob"]
    floor = F.array_min(F.transform(entries, lambda e: e["logprob"]))
    yes, no = first("yes"), first("no")
    p_yes, p_no = F.exp(F.coalesce(yes, floor)), F.exp(F.coalesce(no, floor))
    return F.when(yes.isNotNull() | no.isNotNull(), p_yes / (p_yes + p_no))


def rerank_items(reply: Column) -> Column:
    """index and score of a reranker's JSON reply, in its order; items without either are left out."""
    parsed = F.from_json(reply, "results array<struct<index:int,relevance_score:double,score:double>>")["results"]
    items = F.transform(parsed, lambda r: F.struct(r["index"].alias("idx"), F.coalesce(r["relevance_score"], r["score"]).alias("score")))
    good = F.filter(items, lambda r: r["idx"].isNotNull() & r["score"].isNotNull())
    return F.when(F.size(good) > 0, good)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def locators_unique(before: DataFrame, after: DataFrame, case: str = "qid") -> DataFrame:
    """Per case whether as many distinct (path, qualname) are left as there were. Cases missing after have none."""
    count = lambda df, name: df.groupBy(case).agg(F.countDistinct("path", "qualname").alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), case, "left")
    return both.select(case, "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"), (F.col("n_before") == F.coalesce("n_after", F.lit(0))).alias("unique"))
