"""Indexes: which there are, and their tables as of each publication.

A catalogue under the base folder lists the indexes: the root they cover, the profile they are
made for, and the place of their tables. A publication writes segments of the tables that change,
then a manifest that names every table's segments, and then renames the pointer to that manifest:
readers see all of a publication or nothing. Only these small control files are handled on the
driver; the base folder is a mounted folder that driver and executors share.

An index is made for one profile. Readers with another are told so; a writer with another
begins anew. Manifests that were superseded longer than RETENTION seconds ago go, and with
them the segments that no other manifest names.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hayrick.errors import HayrickError
from hayrick.sources.segments import Segments, Table

VERSION = 3
RETENTION = 3600.0
SYMBOL = "id bigint, repo string, path string, name string, qualname string, kind string, lang string, line int, end_line int, signature string, full_signature string, docstring string, body string, search_text string, embed_text string, embed_key string, source_role string"
#: Each table's columns, the key of its tombstones, and the order of its files. Rows of one frequent term are in several files: ids part them.
KEPT = {
    "files": Segments("repo string, path string, mtime_ns bigint, size bigint, hash string", "path", ("path",)),
    "parse_state": Segments("repo string, path string, status string, detail string, attempted_at double", "path", ("path",)),
    "symbols": Segments(SYMBOL, "id", ("path", "id")),
    "vectors": Segments("repo string, symbol_id bigint, embedding array<float>", "symbol_id", ("symbol_id",)),
    "postings": Segments("term string, id bigint, tf bigint, positions array<int>", "id", ("term", "id")),
    "lengths": Segments("id bigint, dl bigint", "id", ("id",)),
}
TABLES = {name: kept.schema for name, kept in KEPT.items()}
JOURNAL = (
    "job_id string, repo string, mode string, state string, phase string, created_at double, heartbeat_at double, counters map<string,bigint>, failure struct<code:string,message:string,retryable:boolean,next_action:string>, epoch bigint"
)
_OURS = {"catalogue.json", "catalogue.lock", "indexes", "jobs", "vectors"}


def profile_of(model: str | None = None, dim: int | None = None, form: str = "raw") -> str:
    """What an index is made for: terms alone, or terms and the vectors of a model."""
    return json.dumps([model, dim, form]) if model else "terms"


def catalogue(base: str) -> list[dict]:
    """root, profile and place of every index under a base folder."""
    try:
        return json.loads((Path(base) / "catalogue.json").read_text())
    except FileNotFoundError:
        return []
    except ValueError as e:
        raise HayrickError("INTERNAL", f"the catalogue of {base} can't be read", folder=base) from e


def indexed_roots(base: str) -> list[str]:
    """Roots with an index that are still there."""
    return sorted({row["root"] for row in catalogue(base) if os.path.isdir(row["root"])})


class Store:
    """The index of one root, for callers with one profile."""

    def __init__(self, base: str, repo: str, profile: str = "terms"):
        self.base, self.repo, self.profile = Path(base), repo, profile

    def _entry(self) -> dict | None:
        return next((row for row in catalogue(str(self.base)) if row["root"] == self.repo), None)

    @property
    def path(self) -> Path | None:
        """Where the index is; None before a writer made it."""
        entry = self._entry()
        return self.base / "indexes" / entry["place"] if entry else None

    def current(self) -> dict | None:
        """The pointer, whatever its profile; None before the first publication."""
        place = self.path
        try:
            return json.loads((place / "current.json").read_text()) if place else None
        except FileNotFoundError:
            return None

    def epoch(self) -> int:
        """0 before the first publication."""
        found = self.current()
        if found is None:
            return 0
        if not self.fits(found):
            raise HayrickError("INDEX_PROFILE_MISMATCH", "the index was made for another profile; a refresh makes it anew", index=found["profile"], asked=self.profile)
        return found["epoch"]

    def fits(self, pointer: dict) -> bool:
        return (pointer["profile"], pointer["version"]) == (self.profile, VERSION)

    def pointer(self) -> dict:
        if not self.epoch():
            raise HayrickError("INDEX_NOT_READY", "nothing has been published")
        return self.current()

    def _manifest(self, epoch: int) -> dict[str, Table]:
        """The tables as of an epoch."""
        place = self.path
        try:
            found = json.loads((place / f"manifest-{epoch}.json").read_text()) if place and epoch else {}
        except FileNotFoundError:
            raise HayrickError("INDEX_NOT_READY", f"publication {epoch} isn't kept any more", epoch=epoch) from None
        return {name: Table.of(state) for name, state in found.items()}

    def read(self, spark: SparkSession, table: str, epoch: int | None = None) -> DataFrame:
        """A table of an epoch, by default the current one; empty if that has none."""
        epoch = self.epoch() if epoch is None else epoch
        return KEPT[table].read(spark, self._manifest(epoch).get(table, Table()))

    @contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time, also of several processes. A folder that holds something else is left alone; an index of another profile is begun anew."""
        if self.base.is_dir() and not (self.base / "catalogue.json").exists() and {p.name for p in self.base.iterdir()} - _OURS:
            raise HayrickError("INVALID_ARGUMENT", f"{self.base} holds something else than indexes", folder=str(self.base))
        self.base.mkdir(parents=True, exist_ok=True)
        with (self.base / "catalogue.lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if self._entry() is None:
                _replace(self.base / "catalogue.json", [*catalogue(str(self.base)), {"root": self.repo, "profile": self.profile, "place": uuid.uuid4().hex}])
        place = self.path
        place.mkdir(parents=True, exist_ok=True)
        with (place / "writer.lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            found = self.current()
            if found is not None and not self.fits(found):
                self._renew()
                place.mkdir(parents=True, exist_ok=True)
            yield

    def _renew(self) -> None:
        """Another place for the root's index; the old one's readers keep theirs until it is cleared away."""
        with (self.base / "catalogue.lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            rows = [row for row in catalogue(str(self.base)) if row["root"] != self.repo]
            _replace(self.base / "catalogue.json", [*rows, {"root": self.repo, "profile": self.profile, "place": uuid.uuid4().hex}])

    def publish(self, spark: SparkSession, rows: dict[str, DataFrame], over: dict[str, DataFrame] | None = None, **facts: object) -> int:
        """Make one epoch of added rows and keys that are over, and point to it; facts are kept in the pointer. Other tables stay as they are."""
        over, place = over or {}, self.path
        now = self.epoch()
        tables, after = self._manifest(now), now + 1
        for name in {**rows, **over}:
            tables[name] = KEPT[name].publish(spark, tables.get(name, Table()), f"{place}/{name}", after, rows.get(name), over.get(name))
        _replace(place / f"manifest-{after}.json", {name: t.state() for name, t in tables.items()})
        _replace(place / "current.json", {"version": VERSION, "profile": self.profile, "epoch": after, "published_at": time.time(), **facts})
        self._clear(after)
        return after

    def _clear(self, current: int) -> None:
        """Manifests that were superseded long ago go, with segments that only they name."""
        old, named = [], set()
        for path in self.path.glob("manifest-*.json"):
            epoch = int(path.stem.split("-")[1])
            later = self.path / f"manifest-{epoch + 1}.json"
            if epoch < current and later.exists() and time.time() - later.stat().st_mtime > RETENTION:
                old.append(path)
            else:
                named |= {s["place"] for t in json.loads(path.read_text()).values() for kind in t.values() for s in kind}
        for path in old:
            for t in json.loads(path.read_text()).values():
                for s in (s for kind in t.values() for s in kind if s["place"] not in named):
                    shutil.rmtree(s["place"], ignore_errors=True)
            path.unlink()


def _replace(target: Path, content: object) -> None:
    """A control file is there whole or not at all."""
    fd, part = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, target)
