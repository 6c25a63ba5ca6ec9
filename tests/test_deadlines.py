"""Deadlines that hold: jobs are cancelled, calls are not waited for, and what there is by then is the answer."""

import time

import pytest
from pyspark.sql import functions as F

from hayrick.api import Hayrick
from hayrick.config import Settings
from hayrick.deadlines import Deadline, Late
from hayrick.jobs import Job, Journal
from hayrick.plans import index, search
from hayrick.sources.store import Store
from tests.test_index import tree  # noqa: F401


def active(spark):
    return list(spark.sparkContext.statusTracker().getActiveJobsIds())


def settled(spark):
    end = time.time() + 10
    while active(spark) and time.time() < end:
        time.sleep(0.1)
    return not active(spark)


def slow(batches):
    for batch in batches:
        time.sleep(0.2 * batch.num_rows)
        yield batch


def test_jobs_end_with_the_deadline(spark):
    began, until = time.monotonic(), Deadline(spark, 1.0)
    with pytest.raises(Late), until.jobs():
        spark.range(4000).mapInArrow(slow, "id long").agg(F.sum("id")).collect()
    assert time.monotonic() - began < 8 and settled(spark)
    assert spark.range(5).count() == 5  # later jobs are none of its business
    with pytest.raises(Late), until.jobs():
        raise AssertionError("nothing begins when the time is up")


def test_errors_stay_errors(spark):
    until = Deadline(spark, 60)
    with pytest.raises(ZeroDivisionError), until.jobs():
        1 / 0  # noqa: B018
    with pytest.raises(ZeroDivisionError):
        until.call(lambda: 1 / 0)
    assert until.call(lambda a, b: a + b, 1, 2) == 3 and Deadline(spark, None).call(len, "abc") == 3 and Deadline(spark, None).left is None


def test_calls_are_not_waited_for(spark):
    began = time.monotonic()
    with pytest.raises(Late):
        Deadline(spark, 0.3).call(time.sleep, 5)
    assert time.monotonic() - began < 2


def test_search_within_its_time(spark, tree, tmp_path):  # noqa: F811
    store = Store(str(tmp_path / "base"), tree)
    index.refresh(spark, store, tree)
    query = "how to render a page"
    plain = search.search(spark, store, query, 5)
    turned = lambda q, d: ([(i, float(i)) for i in range(len(d))], None)
    late = search.search(spark, store, query, 5, rerank=lambda q, d: time.sleep(60) or turned(q, d), deadline=25.0)
    assert late.reasons == ["DEADLINE_FALLBACK", "RERANK_FALLBACK"] and late.seconds["total"] < 40 and "rerank" not in late.stages
    assert [r["id"] for r in late.results] == [r["id"] for r in plain.results]  # the answer that was there before the reranker was asked
    none = search.search(spark, store, query, 5, rerank=turned, deadline=0.01)
    assert none.results == [] and none.reasons == ["DEADLINE_FALLBACK", "RERANK_FALLBACK"] and none.seconds["total"] < 10 and settled(spark)
    assert plain.epoch == late.epoch == 1
    narrow = search.search(spark, store, query, 50, expansion=False)
    assert len(narrow.results) <= len(search.search(spark, store, query, 50).results)


def test_settings_reach_the_search(spark, tree, tmp_path):  # noqa: F811
    engine = Hayrick(spark, str(tmp_path / "base"), workspaces=[tree], settings=Settings(search_deadline_seconds=0.001))
    engine.refresh()
    found = engine.search("how to render a page")
    assert found["data"]["degradation_reasons"] == ["DEADLINE_FALLBACK"] and found["index"]["epoch"] == 1


def test_only_left_jobs_of_the_own_repository_are_interrupted(spark, tmp_path):
    journal = Journal(spark, str(tmp_path))
    jobs = {name: Job(repo, "refresh", None, state=state) for name, repo, state in (("left", "/a", "running"), ("own", "/a", "queued"), ("other", "/b", "running"), ("done", "/a", "completed"))}
    for job in jobs.values():
        journal.append(job)
    assert journal.reconcile("/a", [jobs["own"].job_id]) == 1
    states = {r["job_id"]: r["state"] for r in journal.jobs().collect()}
    assert {name: states[job.job_id] for name, job in jobs.items()} == {"left": "interrupted", "own": "queued", "other": "running", "done": "completed"}
