"""Models asked in tasks: answers are kept, failures are told and asked again, calls overlap."""

import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from hayrick import models
from hayrick.operators import fusion
from hayrick.plans import model_calls


def counted(log):
    """A model that notes each of its calls in a file of its own."""

    def ask(query, document):
        Path(log, f"{time.time_ns()}-{hash((query, document))}").write_text(f"{query}|{document}")
        if document == "broken" and not Path(log, "mended").exists():
            raise OSError("no answer")
        if document == "odd":
            return "much"
        return None if document is None else len(document) / 10

    return ask


def calls(log):
    return len([p for p in Path(log).iterdir() if p.name != "mended"])


def test_answers_are_paid_once(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/ledger"
    log.mkdir()
    rows = spark.createDataFrame([(1, "q", "ab"), (2, "q", "ab"), (3, "q", "broken"), (4, "r", None), (5, None, "x")], "n int, query string, document string")
    ask = counted(str(log))
    got = {r["n"]: (r["answer"], r["warning"]) for r in model_calls.answered(rows, ["query", "document"], ask, path, wait=0.0, wave=2).collect()}
    assert got == {1: ("0.2", None), 2: ("0.2", None), 3: (None, "OSError: no answer"), 4: ("null", None), 5: ("0.1", None)}
    assert calls(log) == 6  # one for equal rows, three tries of the broken one
    (log / "mended").touch()
    again = {r["n"]: r["answer"] for r in model_calls.answered(rows, ["query", "document"], ask, path, wait=0.0).collect()}
    assert again[3] == "0.6" and calls(log) == 7  # only what had no answer
    assert model_calls.answered(rows, ["query", "document"], ask, path, wait=0.0).count() == 5 and calls(log) == 7
    model_calls.answered(rows, ["query", "document"], ask, path, space="other model", wait=0.0).count()
    assert calls(log) == 11
    assert model_calls.answered(rows.where("false"), ["query", "document"], ask, f"{path}-none").isEmpty()


def test_a_query_with_a_lost_answer_keeps_its_order(spark, tmp_path):
    (tmp_path / "log").mkdir()
    pool = [(1, 1, "q", "a"), (1, 2, "q", "abc"), (1, 3, "q", "ab"), (2, 1, "r", "x"), (2, 2, "r", "odd"), (3, 1, "s", "broken")]
    pool = spark.createDataFrame(pool, "qid int, rank int, query string, document string").withColumn("id", F.col("rank")).withColumn("score", -F.col("rank").cast("double"))
    replies, valid, lost = model_calls.judged(pool, counted(str(tmp_path / "log")), f"file://{tmp_path}/ledger", wait=0.0)
    assert {r["qid"]: r["valid"] for r in valid.collect()} == {1: True, 2: False, 3: False}
    assert {(r["qid"], r["malformed"], r["warning"]) for r in lost.collect()} == {(2, 1, None), (3, 1, "OSError: no answer")}
    order = fusion.apply_rerank(pool, replies, valid, F.col("score")).collect()
    assert [r["rank"] for r in sorted(order, key=lambda r: r["new_rank"]) if r["qid"] == 1] == [2, 3, 1]
    assert [r["rank"] for r in sorted(order, key=lambda r: r["new_rank"]) if r["qid"] == 2] == [1, 2]


def test_calls_overlap_within_a_task(spark, tmp_path):
    def slow(text):
        began = time.time()
        time.sleep(0.3)
        return [began, time.time()]

    rows = spark.range(64).select(F.col("id").cast("string").alias("text"))
    spans = [json.loads(r["answer"]) for r in model_calls.answered(rows, ["text"], slow, f"file://{tmp_path}/ledger", width=8).collect()]
    events = sorted([(b, 1) for b, _ in spans] + [(e, -1) for _, e in spans])
    open_, most = 0, 0
    for _, step in events:
        open_ += step
        most = max(most, open_)
    assert 8 < most <= 8 * spark.sparkContext.defaultParallelism  # several tasks, each with a bounded number of calls


class Judge:
    """An endpoint whose certainty is the document's first letter's."""

    def post(self, path, body):
        time.sleep(0.2)
        sure = {"a": 0.9, "b": 0.1, "c": 0.5}.get(body["prompt"])
        logs = [{"token": "yes", "logprob": __import__("math").log(sure)}, {"token": "no", "logprob": __import__("math").log(1 - sure)}] if sure else [{"token": "maybe", "logprob": 0.0}]
        return {"completion_probabilities": [{"top_logprobs": logs}]}


def test_a_pool_is_judged_in_parallel():
    began = time.time()
    order, warning = models.rerank_by_completion("q", list("abc") * 4, endpoint=Judge(), template="{document}", width=12)
    assert time.time() - began < 1.2 and warning is None
    assert [i % 3 for i, _ in order] == [0] * 4 + [2] * 4 + [1] * 4
    assert models.rerank_by_completion("q", ["a", "z"], endpoint=Judge(), template="{document}", width=2)[0] is None
