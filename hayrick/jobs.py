"""Refresh jobs: one after another for a repository, and a journal.

The journal is an append-only table of events under the index root; the state of a job is its
last one, so jobs of earlier processes are found again; those that a process left behind are
marked as interrupted by the next writer of their repository. A thread for each repository with work runs driver code that submits
Spark jobs; nothing here touches rows.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.errors import HayrickError
from hayrick.operators import maintenance
from hayrick.sources.store import JOURNAL

# States of a job, and what a mode covers.
ACTIVE = ("queued", "running")
COVERS = {"rebuild": ("rebuild", "refresh"), "refresh": ("refresh",)}


@dataclass
class Job:
    repo: str
    mode: str
    paths: tuple[str, ...] | None
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "queued"
    created_at: float = field(default_factory=time.time)
    counters: dict[str, int] = field(default_factory=dict)
    failure: dict | None = None
    epoch: int = 0
    cancel_requested: bool = False
    done: threading.Event = field(default_factory=threading.Event, repr=False, compare=False)

    @property
    def lexical_ready(self) -> bool:
        return self.epoch > 0

    def public(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k not in ("done", "cancel_requested")}
        return out | {"lexical_ready": self.lexical_ready}


class Journal:
    """Events of jobs in a folder of small Parquet files."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/jobs"

    def append(self, job: Job) -> None:
        row = (job.job_id, job.repo, job.mode, job.state, None, job.created_at, time.time(), dict(job.counters), job.failure, job.epoch)
        self.spark.createDataFrame([row], JOURNAL).coalesce(1).write.mode("append").parquet(self.path)

    def jobs(self) -> DataFrame:
        """The last event of each job. Damaged files are passed over."""
        if not Path(self.path).is_dir():
            return self.spark.createDataFrame([], JOURNAL)
        events = self.spark.read.schema(JOURNAL).option("ignoreCorruptFiles", True).parquet(self.path)
        # Of events in one moment the one that ends a job is its last.
        return maintenance.latest(events, "job_id", F.col("heartbeat_at"), (~F.col("state").isin(*ACTIVE)).cast("int"), (F.col("state") == "running").cast("int"))

    def find(self, job_id: str) -> Job | None:
        row = self.jobs().where(F.col("job_id") == job_id).first()
        if row is None:
            return None
        failure = row["failure"].asDict() if row["failure"] else None
        job = Job(row["repo"], row["mode"], None, job_id, row["state"], row["created_at"], dict(row["counters"] or {}), failure, row["epoch"] or 0)
        job.done.set()
        return job

    def reconcile(self, repo: str, own: list[str]) -> int:
        """Queued and running jobs of a repository, but for this process's own, are interrupted from now on; returns how many. For the holder of the repository's writer lock."""
        open_ = self.jobs().where(F.col("state").isin(*ACTIVE) & (F.col("repo") == repo) & ~F.col("job_id").isin(own))
        left = maintenance.reconcile(open_, F.lit(None).cast("string")).withColumn("heartbeat_at", F.lit(time.time()))
        n = open_.count()
        if n:
            left.select([c.name for c in self.spark.createDataFrame([], JOURNAL).schema]).coalesce(1).write.mode("append").parquet(self.path)
        return n


class Jobs:
    """run: (job, cancelled) -> result with state, epoch and counters."""

    def __init__(self, run: Callable[[Job, Callable[[], bool]], dict], journal: Journal | None = None):
        self.run, self.lock, self.journal = run, threading.Lock(), journal
        self.jobs: dict[str, Job] = {}
        self.queues: dict[str, list[Job]] = {}

    def known(self) -> list[str]:
        """Jobs of this process."""
        with self.lock:
            return list(self.jobs)

    def submit(self, repo: str, mode: str = "refresh", paths: list[str] | None = None) -> tuple[Job, str]:
        """A new job, or the first active one that covers it."""
        wanted = None if paths is None else tuple(sorted(set(paths)))
        with self.lock:
            for job in self.queues.get(repo, []):
                if job.state in ACTIVE and not job.cancel_requested and job.paths == wanted and mode in COVERS[job.mode]:
                    return job, "joined"
            job = Job(repo, mode, wanted)
            self.jobs[job.job_id] = job
            self.queues.setdefault(repo, []).append(job)
            self._note(job)
            if len(self.queues[repo]) == 1:
                threading.Thread(target=self._work, args=(repo,), daemon=True).start()
            return job, "started"

    def _note(self, job: Job) -> None:
        if self.journal:
            self.journal.append(job)

    def _work(self, repo: str) -> None:
        while True:
            with self.lock:
                if not self.queues[repo]:
                    del self.queues[repo]
                    return
                job = self.queues[repo][0]
                job.state = "cancelled" if job.cancel_requested else "running"
                self._note(job)
            try:
                if job.state == "running":
                    result = self.run(job, lambda job=job: job.cancel_requested)
                    job.state, job.epoch = result.get("state", "completed"), result.get("epoch", 0)
                    job.counters = {k: v for k, v in result.items() if isinstance(v, int) and k != "epoch"}
            except HayrickError as e:
                job.state, job.failure = "failed", {"code": e.code, "message": e.message, "retryable": False, "next_action": e.payload()["next_action"]}
            except Exception as e:  # the worker outlives any job
                job.state, job.failure = "failed", {"code": "INTERNAL", "message": str(e)[:500], "retryable": True, "next_action": "Start it once more."}
            with self.lock:
                self._note(job)
                self.queues[repo].pop(0)
            job.done.set()

    def get(self, job_id: str, repo: str | None = None) -> Job:
        job = self.jobs.get(job_id) or (self.journal.find(job_id) if self.journal else None)
        if job is None:
            raise HayrickError("JOB_NOT_FOUND", f"no job {job_id}")
        if repo is not None and job.repo != repo:
            raise HayrickError("JOB_REPOSITORY_MISMATCH", "the job belongs to another repository", job_id=job_id)
        return job

    def cancel(self, job_id: str, repo: str | None = None) -> Job:
        """Asked for between units of work; again for a job that has ended it changes nothing."""
        job = self.get(job_id, repo)
        if job.state in ACTIVE:
            job.cancel_requested = True
        return job

    def active(self, repo: str) -> list[dict]:
        with self.lock:
            return [j.public() for j in self.queues.get(repo, [])]
