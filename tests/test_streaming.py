import datetime
import os
import subprocess
import time

import pandas as pd
from pyspark.sql import functions as F

from hayrick.operators import maintenance
from hayrick.plans import index
from hayrick.sources import worktree
from hayrick.sources.store import Store
from hayrick.streaming import freshness, watch

T = datetime.datetime(2024, 1, 1)


def changes(spark, rows):
    return spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], freshness.CHANGES)


def test_runs_of_changes(spark):
    at = lambda s: T + datetime.timedelta(seconds=s)
    rows = [(1, "a", at(0), False), (1, "b", at(5), True), (1, "c", at(16), False), (2, "a", at(0), False), (3, "a", at(0), False), (3, "b", at(10), False), (3, "c", at(19), False)]
    found = {(r["repo"], r["n"], r["full"]) for r in freshness.session_submissions(changes(spark, rows), 10).collect()}
    assert found == {(1, 2, True), (1, 1, False), (2, 1, False), (3, 1, False), (3, 2, False)}
    batch = maintenance.sessions(changes(spark, rows), 10, ["repo"]).collect()
    assert sorted((r["repo"], r["n"]) for r in batch) == sorted((r, n) for r, n, _ in found)


def test_unpublished_changes(spark):
    schema = "repo bigint, path string, mtime_ns bigint, size bigint"
    now = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 1), (2, "a", 1, 1)], schema)
    seen = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 1)], schema)
    assert {(r["repo"], r["path"]) for r in freshness.unpublished(now, seen).collect()} == {(1, "b"), (2, "a")}


PACE = watch.Pace(debounce_ms=1_000, interval_ms=2_000, longest_ms=300_000, most=3)


class Replay:
    """The watch of one repository, event by event, on a clock of seconds."""

    def __init__(self, published):
        self.repo, self.entries, self.tick = watch.Repo(), {}, 0
        self.events([("r", "published", p, m, s, h, None) for p, (m, s, h) in published.items()] + [("r", "published", None, None, None, None, None)], 0)

    def events(self, rows, now):
        df = pd.DataFrame(rows, columns=[c.split()[0] for c in watch.EVENTS.split(", ")])
        self.repo = watch.heard(self.repo, self.entries, df, int(1000 * now), PACE)

    def see(self, tree, now, whole=True):
        """A tick; what is asked for then: None, or the paths (["*"]: the whole tree)."""
        self.tick += 1
        rows = [("r", "seen", p, *(f if len(f) == 3 else (*f, None)), self.tick) for p, f in tree.items()]
        self.events(rows + ([("r", "seen", None, None, None, None, self.tick)] if whole else []), now)
        return self.ask(now)

    def ask(self, now):
        self.repo, paths, n = watch.request(self.repo, self.entries, int(1000 * now), PACE)
        return None if n is None else paths or ["*"]

    def end(self, kind, now):
        self.events([("r", kind, None, None, None, None, None)], now)


def test_watch_waits_for_quiet_and_names_all_changes():
    w = Replay({"a": (1, 5, "A"), "b": (1, 5, "B")})
    assert w.see({"a": (1, 5), "b": (1, 5)}, 1) is None
    assert w.see({"a": (2, 5), "b": (1, 5)}, 2) is None
    assert w.see({"a": (2, 5), "b": (1, 5), "n": (2, 9)}, 2.9) is None  # a new change begins the wait again
    assert w.ask(3.5) is None and w.ask(3.9) == ["a", "n"]
    assert w.see({"a": (2, 5), "b": (7, 5), "n": (2, 9)}, 6) is None  # one request at a time
    assert w.ask(9) is None
    w.end("settled", 10)
    assert w.ask(10) == ["b"]  # what changed meanwhile
    w.end("settled", 11)
    assert w.see({"a": (2, 5), "b": (7, 5), "n": (2, 9)}, 20) is None


def test_watch_of_edits_that_keep_time_and_size():
    w = Replay({"a": (1, 5, "A"), "b": (1, 5, "B")})
    assert w.see({"a": (1, 5, "A"), "b": (1, 5, "X")}, 1) is None
    assert w.see({"a": (1, 5), "b": (1, 5)}, 3) == ["b"]  # ticks without contents don't forget it
    w.end("settled", 4)
    assert w.see({"a": (1, 5, "A"), "b": (1, 5, "X")}, 40) is None and w.ask(50) is None


def test_watch_of_failures():
    w = Replay({"a": (1, 5, "A")})
    w.see({"a": (2, 5)}, 1)
    assert w.ask(2) == ["a"]
    w.end("failed", 3)
    assert w.repo.failures == 1 and w.ask(6.9) is None and w.ask(7) == ["a"]
    w.end("failed", 8)
    assert w.repo.failures == 2 and w.ask(15.9) is None and w.ask(16) == ["a"]
    w.end("failed", 17)
    assert w.see({"a": (3, 5)}, 18) is None and w.repo.failures == 0  # a fresh change ends the wait
    assert w.ask(19) == ["a"]
    w.end("settled", 20)
    assert w.ask(400) is None
    for k in range(12):
        w.see({"a": (9, 9)}, 1000) if not k else None
        assert w.ask(1000 + 400 * (k + 1)) == ["a"]
        w.end("failed", 1000 + 400 * (k + 1))
    assert w.repo.wait_until_ms == 1000 * (1000 + 400 * 12 + 300)


def test_watch_of_what_a_refresh_leaves_out():
    """A file that can't be parsed is asked for once; so is one that was undone, but not again."""
    w = Replay({"a": (1, 5, "A")})
    w.see({"a": (2, 6), "bad": (1, 1)}, 1)
    assert w.ask(2) == ["a", "bad"]
    w.end("settled", 3)
    for now in (5, 50, 500):
        assert w.see({"a": (2, 6), "bad": (1, 1)}, now) is None
    w.see({"a": (2, 6), "bad": (2, 1)}, 600)
    w.see({"a": (2, 6), "bad": (1, 1)}, 600.5)
    assert w.ask(700) is None


def test_watch_of_deletions_and_of_trees_that_are_away():
    w = Replay({"a": (1, 5, "A"), "b": (1, 5, "B")})
    w.see({"a": (2, 5)}, 1)
    assert w.ask(2) == ["*"]
    w.end("failed", 3)
    assert w.ask(8) == ["*"]
    w.end("settled", 9)
    assert set(w.entries) == {"a"} and w.ask(20) is None
    assert w.see({}, 30, whole=False) is None and w.ask(40) is None and set(w.entries) == {"a"}


def test_watch_loses_no_change_beyond_the_most_it_names():
    w = Replay({})
    w.see({f"f{i}": (1, 1) for i in range(8)}, 1)
    named = []
    for now in (2, 4, 6):
        named += w.ask(now)
        w.end("settled", now + 1)
    assert named == [f"f{i}" for i in range(8)] and w.ask(10) is None


def test_nothing_is_asked_for_before_a_first_publication():
    w = Replay({})
    w.repo, w.entries = watch.Repo(), {}
    assert w.see({"a": (1, 1)}, 1) is None and w.ask(10) is None


def tree_of(tmp_path):
    root = str(tmp_path / "tree")
    os.makedirs(root)
    for n in ("a.py", "b.py", "c.py"):
        put(root, n, "x = 1\n", 10**18)
    subprocess.run("git init -q . && git add -A && git -c user.name=a -c user.email=a@b.c commit -qm x", shell=True, cwd=root, check=True)
    return root


def put(root, name, content, at=None):
    with open(f"{root}/{name}", "w") as f:
        f.write(content)
    if at:
        os.utime(f"{root}/{name}", ns=(at, at))


def test_watch_as_a_stream(spark, tmp_path):
    """A tree, its index and the stream between them: edits, hidden edits, a refresh that raises, a deletion."""
    root = tree_of(tmp_path)
    store, asked, answers = Store(str(tmp_path / "base"), root), [], []

    def refresh(paths):
        asked.append(paths)
        if answers:
            raise RuntimeError(answers.pop())
        return index.refresh(spark, store, root, paths=paths)["state"]

    def until(n):
        end = time.time() + 90
        while time.time() < end and len(asked) < n and query.isActive:
            time.sleep(0.3)
        assert query.isActive, query.exception()
        return asked[n - 1 :]

    index.refresh(spark, store, root)
    query = watch.watch(spark, store, root, refresh, f"file://{tmp_path}/watch", interval=0.5, debounce=0.3, content_interval=3)
    try:
        time.sleep(8)  # what is published has to come round
        assert asked == []
        put(root, "a.py", "def fresh():\n    pass\n")
        assert until(1) == [["a.py"]]
        put(root, "b.py", "y = 1\n", 10**18)  # the same time and size
        assert until(2) == [["b.py"]]
        answers.append("no")
        put(root, "c.py", "z = 333\n")
        assert until(4) == [["c.py"]] and asked[2] == ["c.py"]
        os.remove(f"{root}/a.py")
        assert until(5) == [None]
        end = time.time() + 60
        while time.time() < end and store.read(spark, "files").count() > 2:
            time.sleep(0.5)
        assert {r["path"] for r in store.read(spark, "files").collect()} == {"b.py", "c.py"}
    finally:
        query.stop()


def test_worktree_source(spark, tmp_path):
    """Sizes and contents come from tasks; predicates on paths thin out the names; what is gone has a row without content."""
    root = tree_of(tmp_path)
    put(root, "sub.go", "package p\n")
    os.symlink("a.py", f"{root}/link.py")
    put(root, "large.py", "x" * 1_000_001)
    worktree.register(spark)
    df = spark.read.format("worktree").option("root", root).option("content", "true").load()
    found = {r["path"]: r for r in df.collect()}
    assert sorted(found) == ["a.py", "b.py", "c.py", "large.py", "link.py", "sub.go"]
    assert [p for p, r in sorted(found.items()) if r["content"] is None] == ["large.py", "link.py"] == [p for p, r in sorted(found.items()) if r["size"] is None]
    assert bytes(found["sub.go"]["content"]) == b"package p\n" and found["a.py"]["mtime_ns"] == 10**18
    assert {r["path"] for r in df.where("path in ('a.py', 'sub.go', 'nothing.py')").collect()} == {"a.py", "sub.go"}
    assert {r["path"] for r in df.where(F.col("path").startswith("s")).collect()} == {"sub.go"}
    reader = worktree._Reader(root, True)
    assert list(reader.pushFilters([worktree.EqualTo(("path",), "a.py"), worktree.EqualTo(("size",), 3)])) == [worktree.EqualTo(("size",), 3)]
    parts = reader.partitions()
    os.remove(f"{root}/a.py")
    assert [p.names for p in parts] == [["a.py"]] and list(reader.read(parts[0])) == [(root, "a.py", None, None, None, None)]
