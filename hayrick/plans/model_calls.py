"""Models asked row by row inside tasks, and a ledger of their answers.

The ledger is a folder of Parquet that Spark appends to, in a store that driver and executors
share. Rows are asked in waves; a wave is one write without a shuffle after the calls, so what
a task has finished stays when its executor is lost, and a wave that is written isn't asked
again by a later run, whatever became of the earlier one. Equal inputs are asked once.

Within a task up to `width` calls are open at a time. A call that fails is repeated after
doubling waits; if it fails to the end, the row has a warning instead of an answer and is
asked again by the next run.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrick.operators import fusion
from hayrick.sources import scratch

LEDGER = "ledger_key string, answer string, warning string"
FAILURES = (OSError, KeyError, IndexError, TypeError, ValueError)
WIDTH, TRIES, WAIT, WAVE = 8, 3, 0.5, 100_000


def attempt(ask: Callable, values: tuple, tries: int = TRIES, wait: float = WAIT) -> tuple[str | None, str | None]:
    """The answer as JSON, or a warning."""
    for n in range(tries):
        try:
            return json.dumps(ask(*values), allow_nan=False), None
        except FAILURES as e:
            said = f"{type(e).__name__}: {e}"
        if n + 1 < tries:
            time.sleep(wait * 2**n)
    return None, said


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """ledger_key, answer and warning; an answer counts more than a warning."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], LEDGER)
    best = F.max(F.struct(F.col("answer").isNotNull().alias("has"), "answer", "warning")).alias("b")
    return rows.groupBy("ledger_key").agg(best).select("ledger_key", "b.answer", "b.warning")


def answered(rows: DataFrame, inputs: list[str], ask: Callable, path: str, *, space: str = "", width: int = WIDTH, tries: int = TRIES, wait: float = WAIT, wave: int = WAVE) -> DataFrame:
    """rows with `answer` (JSON) and `warning` of ask(*inputs); space: the model and form that answers come from.

    Null inputs are asked as None; repeated rows share an answer; without rows nobody is asked.
    """
    spark = rows.sparkSession
    given = F.to_json(F.struct(F.lit(space).alias("ledger_space"), *inputs), {"ignoreNullFields": "false"})
    keyed = scratch.written(rows.drop("answer", "warning").withColumn("ledger_key", F.sha2(given, 256)), "asked")
    done = ledger(spark, path).where(F.col("answer").isNotNull()).select("ledger_key")
    todo = keyed.select("ledger_key", *inputs).join(done, "ledger_key", "left_anti").dropDuplicates(["ledger_key"])
    todo = scratch.written(todo, "unasked", by="ledger_key")
    waves = math.ceil(todo.count() / wave)
    tasks = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(width) as calls:
            for batch in batches:
                values = batch[inputs].astype(object).where(batch[inputs].notna(), None)
                got = list(calls.map(lambda v: attempt(ask, v, tries, wait), values.itertuples(index=False, name=None)))
                yield pd.DataFrame({"ledger_key": batch["ledger_key"], "answer": [a for a, _ in got], "warning": [w for _, w in got]}).astype(object)

    for n in range(waves):
        mine = todo.where(F.pmod(F.xxhash64("ledger_key"), F.lit(waves)) == n)
        mine.repartition(tasks).mapInPandas(run, LEDGER).write.mode("append").parquet(path)
    return keyed.join(ledger(spark, path), "ledger_key", "left").drop("ledger_key")


def judged(pool: DataFrame, judge: Callable[[str, str], float], path: str, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pool (qid, rank from 1, query, document) judged document by document.

    Replies as fusion.apply_rerank takes them (qid, idx, score, response_pos), which queries' replies are
    valid, and for each query how many documents have no usable answer, with one of the warnings.
    """
    score = F.get_json_object(F.concat(F.lit('{"a":'), "answer", F.lit("}")), "$.a").try_cast("double")
    got = answered(pool.select("qid", "rank", "query", "document"), ["query", "document"], judge, path, **how).withColumn("score", score)
    got = scratch.written(got.select("qid", "rank", "score", "warning"), "judged")
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "rank")
    replies = got.select("qid", (F.col("rank") - 1).alias("idx"), "score", (F.row_number().over(order) - 1).alias("response_pos"))
    sizes = got.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    lost = got.where(F.col("score").isNull()).groupBy("qid").agg(F.count(F.lit(1)).alias("malformed"), F.min("warning").alias("warning"))
    return replies, fusion.valid_orders(replies, sizes), lost
