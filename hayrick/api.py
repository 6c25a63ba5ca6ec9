"""Calls that answer with an envelope: search, map, refresh, status, jobs and workspaces."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from hayrick.config import Settings
from hayrick.errors import HayrickError, envelope
from hayrick.jobs import Job, Journal, Jobs
from hayrick.plans import index, search
from hayrick.sources import inventory, store
from hayrick.sources.vector_cache import VectorCache
from hayrick.sources.scratch import shared_folder
from hayrick.streaming import watch


class Hayrick:
    """Indexes under `base`; models are injected callables. A call without a repo means the only workspace, if there is one."""

    def __init__(self, spark: SparkSession, base: str | None = None, *, workspaces: list[str] | None = None, settings: Settings | None = None, expand=None, embed=None, rerank=None):
        self.settings = settings or Settings.of(spark)
        self.spark, self.base = spark, base or self.settings.index_dir
        form = self.settings.embed_input_format
        self.profile = store.profile_of(self.settings.embed_model, self.settings.embed_dim, form) if embed else store.profile_of()
        self.cache = VectorCache(self.base, self.profile, self.settings.embed_dim) if embed else None
        self.workspaces = [os.path.realpath(w) for w in workspaces or []]
        self.models = {"expand": expand, "embed": embed, "rerank": rerank}
        self.journal = Journal(spark, self.base)
        self.jobs = Jobs(self._refresh, self.journal)

    def _refresh(self, job: Job, cancelled) -> dict:
        """Parse and publish, then attach vectors; without all of them the job is degraded."""
        at = self.store(job.repo)
        with at.writing():  # whoever holds the lock is the only writer: other jobs that seem to run were left behind
            self.journal.reconcile(job.repo, self.jobs.known())
        done = index.refresh(self.spark, at, job.repo, rebuild=job.mode == "rebuild", paths=None if job.paths is None else list(job.paths), cancelled=cancelled, job_id=job.job_id)
        if done["state"] != "completed" or not self.cache or cancelled():
            return done
        vectors = index.embed(self.spark, at, self.cache, self.models["embed"])
        return done | vectors | {"state": "degraded" if vectors["missing"] else "completed"}

    def watch(self, repo: str | None = None):
        """A running stream that refreshes the index when the worktree changes; None if watching is switched off."""
        root, s = self.resolve(repo), self.settings
        if not s.watch_interval:
            return None

        def submit(paths: list[str] | None) -> str:
            job, _ = self.jobs.submit(root, "refresh", paths)
            job.done.wait()
            return job.state

        folder = f"{shared_folder(self.spark)}/hayrick/watch-{uuid.uuid4().hex}"
        return watch.watch(self.spark, self.store(root), root, submit, folder, interval=s.watch_interval, debounce=s.watch_debounce, content_interval=s.watch_content_interval)

    def store(self, repo: str) -> store.Store:
        return store.Store(self.base, repo, self.profile)

    def resolve(self, repo: str | None) -> str:
        """Explicit, or the single workspace; never a guess."""
        if repo is not None:
            if not os.path.isabs(repo) or not os.path.isdir(repo):
                raise HayrickError("REPOSITORY_NOT_FOUND", f"no such folder: {repo}", repo=repo)
            return inventory.root_of(repo)
        if len(self.workspaces) == 1:
            return self.workspaces[0]
        if not self.workspaces:
            raise HayrickError("REPOSITORY_NOT_SELECTED", "no repository was named")
        raise HayrickError("AMBIGUOUS_WORKSPACE", "several workspaces are configured", candidates=self.workspaces)

    def _answer(self, repo: str | None, work) -> dict:
        root = repo
        try:
            root = self.resolve(repo)
            return envelope(root, **work(root))
        except HayrickError as e:
            return envelope(root, error=e)

    def search(self, query: str, repo: str | None = None, k: int = 10, mode: str = "balanced", intent: str = "implementation", **options) -> dict:
        def work(root: str) -> dict:
            found = search.search(self.spark, self.store(root), query, k, mode=mode, intent=intent, **{"limit": self.settings.candidate_limit, "deadline": self.settings.search_deadline_seconds, "cache": self.cache, "expansion": self.settings.pool_expansion, **self.models, **options})
            data = {"results": found.results, "stages_used": found.stages, "degraded": bool(found.reasons), "degradation_reasons": found.reasons}
            return {"data": data, "warnings": found.warnings, "timings": found.seconds, "index": {"epoch": found.epoch}}

        return self._answer(repo, work)

    def map(self, glob: str = "**", repo: str | None = None, limit: int = 100, offset: int = 0) -> dict:
        return self._answer(repo, lambda root: {"data": search.map_symbols(self.spark, self.store(root), glob, limit, offset)})

    def refresh(self, repo: str | None = None, rebuild: bool = False, paths: list[str] | None = None, wait: bool = True) -> dict:
        def work(root: str) -> dict:
            job, how = self.jobs.submit(root, "rebuild" if rebuild else "refresh", paths)
            if wait:
                job.done.wait()
            return {"data": job.public() | {"submitted": how}}

        return self._answer(repo, work)

    def job(self, job_id: str, repo: str | None = None) -> dict:
        return self._answer(repo, lambda root: {"data": self.jobs.get(job_id, root).public()})

    def cancel(self, job_id: str, repo: str | None = None) -> dict:
        return self._answer(repo, lambda root: {"data": self.jobs.cancel(job_id, root).public()})

    def status(self, repo: str | None = None) -> dict:
        return self._answer(repo, lambda root: {"data": index.status(self.spark, self.store(root), root, self.jobs.active(root))})

    def list_workspaces(self) -> dict:
        """Configured ones and those with an index, each with where it is from."""
        known = store.indexed_roots(self.base)
        rows = [{"root": r, "configured": r in self.workspaces, "indexed": r in known} for r in sorted({*self.workspaces, *known})]
        return envelope(None, {"workspaces": rows})
