"""Watching a worktree as a stream with state by path.

Ticks of the tree (sources/worktree.py) and reports (what is published, how refreshes ended)
are one stream of events, grouped by repository. Its state is a map from path to two
fingerprints of the file: as last seen, and as last settled, which a publication or a refresh
that succeeded did. A path is due while the two differ; nothing else is remembered of it, so what a
refresh leaves out is settled like what it publishes, and an edit that is undone isn't due any more. The
repository has a quiet period after the newest change, one request at a time, and waits that
double after each failure until a change comes.

Requests are the stream's output. Its sink runs them and writes the report, which comes back
as an event, so a restart goes on from the checkpoint: a request without a report is made
again. Requests name MOST paths at most; what is left is due after the report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hayrick.sources import worktree
from hayrick.sources.store import Store

#: refresh(paths), with None for the whole tree, gives the final state of that refresh.
Refresh = Callable[[list[str] | None], str]
SETTLING = ("completed", "degraded")
MOST = 10_000
EVENTS = "repo string, kind string, path string, mtime_ns bigint, size bigint, hash string, tick bigint"
REQUESTS = "repo string, paths array<string>, whole boolean, n int, failures int, at_ms bigint"
_PRINT = "struct<mtime_ns:bigint,size:bigint,hash:string>"
_ENTRY = f"seen {_PRINT}, settled {_PRINT}, asked {_PRINT}, named boolean"
_REPO = "begun boolean, busy boolean, failures int, changed_ms bigint, wait_until_ms bigint"

#: mtime_ns, size and hash of a file (the hash None where nobody looked); None for no file.
Print = tuple[int, int, str | None] | None


def differ(a: Print, b: Print) -> bool:
    """Whether two fingerprints are of different contents, as far as both tell."""
    if a is None or b is None:
        return a is not b
    return a[:2] != b[:2] or None not in (a[2], b[2]) and a[2] != b[2]


@dataclass(frozen=True)
class Entry:
    seen: Print = None
    settled: Print = None
    asked: Print = None  # as it was when a request named it
    named: bool = False  # in the request that is under way

    @property
    def due(self) -> bool:
        return differ(self.seen, self.settled)

    def look(self, now: Print) -> Entry:
        """After a look at the file; a look that read no content keeps the hash of an equal file."""
        if now and self.seen and now[:2] == self.seen[:2] and now[2] is None:
            now = self.seen
        return replace(self, seen=now)


@dataclass(frozen=True)
class Repo:
    begun: bool = False
    busy: bool = False
    failures: int = 0
    changed_ms: int = 0
    wait_until_ms: int = 0


@dataclass(frozen=True)
class Pace:
    debounce_ms: int = 500
    interval_ms: int = 2_000
    longest_ms: int = 300_000
    most: int = MOST


def heard(repo: Repo, entries: dict[str, Entry], events: pd.DataFrame, now: int, pace: Pace) -> Repo:
    """The repository after events; entries change in place."""
    for kind, some in events[events["kind"] != "seen"].groupby("kind", sort=True):
        if kind == "published" and not repo.begun:
            for e in some[some["path"].notna()].itertuples():
                known = (int(e.mtime_ns), int(e.size), e.hash)
                entries[e.path] = Entry(known, known)
            repo = replace(repo, begun=True)
        elif kind in ("settled", "failed"):
            for path, entry in list(entries.items()):
                if entry.named:
                    entries[path] = replace(entry, settled=entry.asked if kind == "settled" else entry.settled, asked=None, named=False)
                    if entries[path] == Entry():
                        del entries[path]
            failures = repo.failures + 1 if kind == "failed" else 0
            wait = min(pace.interval_ms * 2**failures, pace.longest_ms) if failures else 0
            repo = replace(repo, busy=False, failures=failures, wait_until_ms=now + wait if wait else 0)
    seen = events[events["kind"] == "seen"]
    if repo.begun and len(seen):
        last = seen[seen["tick"] == seen["tick"].max()]
        whole = bool(last["path"].isna().any())
        looks: dict[str, Print] = {e.path: (int(e.mtime_ns), int(e.size), e.hash if isinstance(e.hash, str) else None) for e in last[last["path"].notna()].itertuples()}
        if whole:
            looks |= {path: None for path in entries if path not in looks}
        fresh = False
        for path, now_seen in looks.items():
            before = entries.get(path, Entry())
            after = before.look(now_seen)
            fresh |= differ(after.seen, before.seen)
            if after == Entry():
                entries.pop(path, None)
            elif after != before:
                entries[path] = after
        if fresh:
            repo = replace(repo, changed_ms=now, failures=0, wait_until_ms=0)
    return repo


def request(repo: Repo, entries: dict[str, Entry], now: int, pace: Pace) -> tuple[Repo, list[str] | None, int | None]:
    """The repository, paths (None: the whole tree) and their number if a refresh is to be made now; else a number of None. Entries that are asked for say so."""
    due = sorted(path for path, e in entries.items() if e.due)
    if not due or repo.busy or not repo.begun or now < moment(repo, pace):
        return repo, None, None
    gone = [path for path in due if entries[path].seen is None]
    named = due if gone else due[: pace.most]
    for path in named:
        entries[path] = replace(entries[path], asked=entries[path].seen, named=True)
    return replace(repo, busy=True), None if gone else named, len(named)


def moment(repo: Repo, pace: Pace) -> int:
    """When the next request may be made."""
    return max(repo.changed_ms + pace.debounce_ms, repo.wait_until_ms)


class Watch(StatefulProcessor):
    """Events of a repository to requests; its files are entries of a map, of which only those that change are written."""

    def __init__(self, pace: Pace):
        self.pace = pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", _ENTRY)
        self.repo = handle.getValueState("repo", _REPO)

    def _entries(self) -> dict[str, Entry]:
        plain = lambda p: None if p is None else (p["mtime_ns"], p["size"], p["hash"])
        return {k[0]: Entry(*(plain(v[i]) for i in range(3)), v[3]) for k, v in self.files.iterator()}

    def _step(self, key: tuple, now: int, events: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = self.repo.get() if self.repo.exists() else None
        repo, entries = Repo(*known) if known else Repo(), self._entries()
        before = dict(entries)
        if events:
            repo = heard(repo, entries, pd.concat(events), now, self.pace)
        repo, paths, n = request(repo, entries, now, self.pace)
        for path in before.keys() - entries.keys():
            self.files.removeKey((path,))
        for path, entry in entries.items():
            if before.get(path) != entry:
                self.files.updateValue((path,), (entry.seen, entry.settled, entry.asked, entry.named))
        self.repo.update((repo.begun, repo.busy, repo.failures, repo.changed_ms, repo.wait_until_ms))
        if n is not None:
            yield pd.DataFrame({"repo": [key[0]], "paths": [paths], "whole": [paths is None], "n": [n], "failures": [repo.failures], "at_ms": [now]})
        elif repo.begun and not repo.busy and any(e.due for e in entries.values()):
            self.handle.registerTimer(max(now + 1, moment(repo, self.pace)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        yield from self._step(key, timerValues.getCurrentProcessingTimeInMs(), list(rows))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._step(key, timerValues.getCurrentProcessingTimeInMs(), [])


def requests(events: DataFrame, pace: Pace = Pace()) -> DataFrame:  # noqa: B008
    """The requests of a stream of events (EVENTS)."""
    return events.groupBy("repo").transformWithStateInPandas(Watch(pace), REQUESTS, "append", "ProcessingTime")


def watch(spark: SparkSession, store: Store, root: str, refresh: Refresh, folder: str, *, interval: float = 2.0, debounce: float = 0.5, content_interval: float = 30.0, longest: float = 300.0, most: int = MOST) -> StreamingQuery:
    """A running stream that refreshes the index of a worktree when its files change. folder: for reports and the checkpoint, in the shared store."""
    worktree.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [c.split()[0] for c in EVENTS.split(", ")]
    reports = f"{folder.rstrip('/')}/reports"
    report = lambda rows: rows.select(names).coalesce(1).write.mode("append").parquet(reports)
    said = lambda kind: spark.createDataFrame([(root, kind, None, None, None, None, None)], EVENTS)
    report(said("opened"))
    ticks = spark.readStream.format("worktree_ticks").option("root", root).option("content_ms", str(int(1000 * content_interval))).load().withColumn("kind", F.lit("seen"))
    back = spark.readStream.schema(EVENTS).parquet(reports)
    pace = Pace(int(1000 * debounce), int(1000 * interval), int(1000 * longest), most)
    begun: list[bool] = []

    def sink(batch: DataFrame, number: int) -> None:
        if not begun and store.current() and store.epoch():
            known = store.read(spark, "files").withColumns({"kind": F.lit("published"), "repo": F.lit(root), "tick": F.lit(None).cast("bigint")})
            report(known.select(names).unionByName(said("published")))
            begun.append(True)
        for row in batch.collect():  # one a repository
            try:
                state = refresh(None if row["whole"] else list(row["paths"]))
            except Exception:  # a refresh that can't even begin has failed; the watch goes on
                state = "failed"
            report(said("settled" if state in SETTLING else "failed"))

    found = requests(ticks.select(names).unionByName(back.select(names)), pace)
    return found.writeStream.outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(processingTime=f"{int(1000 * interval)} milliseconds").foreachBatch(sink).start()
