"""The engine as a caller sees it: vectors and their cache, the journal, settings, texts."""

import os

import pytest
from pyspark.sql import functions as F

from hayrick import render
from hayrick.api import Hayrick
from hayrick.config import Settings
from hayrick.errors import HayrickError
from hayrick.jobs import Job, Journal, Jobs
from hayrick.plans import evaluation, index
from hayrick.sources import inventory
from hayrick.sources.store import Store
from hayrick.sources.symbols import PARSED, parse_source, preflight
from hayrick.sources.vector_cache import DOCUMENT, QUERY, VectorCache
from tests.test_index import tree, write  # noqa: F401

CALLS = []


def embedder(texts, query):
    return [[float(len(t) % 7), 1.0, float("page" in t), 0.5] for t in texts], None


def counting(texts, query):
    CALLS.append(list(texts))
    return embedder(texts, query)


def down(texts, query):
    return None, "no answer"


def test_refresh_attaches_vectors(spark, tree, tmp_path):  # noqa: F811
    base = str(tmp_path / "base")
    settings = Settings(embed_model="m", embed_dim=4)
    engine = Hayrick(spark, base, workspaces=[tree], settings=settings, embed=embedder)
    job = engine.refresh()["data"]
    assert job["state"] == "completed" and job["counters"]["attached"] > 0 and job["counters"]["missing"] == 0
    found = engine.search("how to render a page")
    assert found["data"]["stages_used"] == ["lexical", "dense"] and not found["data"]["degraded"]
    n = engine.cache.read(spark, DOCUMENT).count()
    # another index under the same folder takes its vectors from the cache, whatever the model says
    again = Hayrick(spark, base, workspaces=[tree], settings=settings, embed=down)
    rebuilt = again.refresh(rebuild=True)["data"]
    assert rebuilt["state"] == "completed" and engine.cache.read(spark, DOCUMENT).count() == n
    write(tree, "src/more.py", "def added(x):\n    return x\n")
    degraded = again.refresh()["data"]
    assert degraded["state"] == "degraded" and degraded["counters"]["missing"] == 1
    status = again.status()["data"]
    assert status["freshness"] == "fresh" and status["without_vector"] == 1 and status["reasons"] == ["DENSE_INDEX_PARTIAL"] and status["jobs"] == []
    assert again.store(tree).pointer()["job_id"] == rebuilt["job_id"] or again.store(tree).pointer()["job_id"]


def test_only_changed_files_are_indexed_anew(spark, tree, tmp_path):  # noqa: F811
    store = Store(str(tmp_path / "base"), tree)
    index.refresh(spark, store, tree)
    write(tree, "src/widgets.py", "def other(x):\n    return x\n")
    index.refresh(spark, store, tree)
    symbols = store.read(spark, "symbols")
    postings, lengths = (sorted(map(tuple, df.collect())) for df in index.terms_of(symbols))
    assert sorted(map(tuple, store.read(spark, "postings").collect())) == postings
    assert sorted(map(tuple, store.read(spark, "lengths").collect())) == lengths
    ids = [r["id"] for r in symbols.orderBy("id").collect()]
    assert len(set(ids)) == len(ids)


def test_cache_heals(spark, tmp_path):
    cache = VectorCache(str(tmp_path), "space", 2)
    assert cache.read(spark, DOCUMENT).count() == 0
    rows = [("a", 2, [1.0, 2.0]), ("b", 3, [1.0, 2.0, 3.0]), ("c", 2, [1.0])]
    cache.store(spark.createDataFrame(rows, "input_hash string, dim int, vector array<float>"), DOCUMENT)
    cache.store(spark.createDataFrame([("a", 2, [5.0, 6.0])], "input_hash string, dim int, vector array<float>"), DOCUMENT)
    assert {r["input_hash"]: list(r["vector"]) for r in cache.read(spark, DOCUMENT).collect()} == {"a": [5.0, 6.0]}
    assert VectorCache(str(tmp_path), "other", 2).read(spark, DOCUMENT).count() == 0 and cache.read(spark, QUERY).count() == 0
    for folder, _, names in os.walk(cache.path):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"damaged")
    assert cache.read(spark, DOCUMENT).count() == 0


def test_vectors_of_queries(spark, tmp_path):
    cache = VectorCache(str(tmp_path), "space", 4)
    CALLS.clear()
    first, _ = cache.of_queries(spark, ["a", "bb", "a"], counting, batch=1)
    assert first == embedder(["a", "bb", "a"], True)[0] and CALLS == [["a"], ["bb"]]
    second, _ = cache.of_queries(spark, ["bb", "ccc"], counting)
    assert CALLS[2:] == [["ccc"]] and second == embedder(["bb", "ccc"], True)[0]
    assert cache.of_queries(spark, ["a", "new"], down) == (None, "no answer")
    assert cache.of_queries(spark, ["a"], down)[0] == embedder(["a"], True)[0]


def test_journal_outlives_its_process(spark, tmp_path):
    journal = Journal(spark, str(tmp_path))
    jobs = Jobs(lambda job, cancelled: {"state": "completed", "epoch": 2, "files": 5}, journal)
    job, _ = jobs.submit("r")
    assert job.done.wait(60)
    lost = Job("r", "refresh", None, state="running")
    journal.append(lost)
    later = Jobs(lambda job, cancelled: {}, Journal(spark, str(tmp_path)))
    done = later.get(job.job_id, "r")
    assert (done.state, done.epoch, done.counters) == ("completed", 2, {"files": 5})
    assert later.get(lost.job_id).state == "running"  # another process may be at it, until the repository has another writer
    later.journal.reconcile("r", later.known())
    assert later.get(lost.job_id).state == "interrupted"
    assert later.journal.jobs().where(F.col("state").isin("queued", "running")).isEmpty()
    with pytest.raises(HayrickError):
        later.get(job.job_id, "another")


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("HAYRICK_EMBED_DIM", "8")
    monkeypatch.setenv("HAYRICK_BASE_URL", "http://all")
    spark.conf.set("hayrick.watch_interval", "0.5")
    spark.conf.set("hayrick.pool_expansion", "false")
    try:
        s = Settings.of(spark, embed_model="m")
        assert (s.embed_dim, s.watch_interval, s.pool_expansion, s.embed_model) == (8, 0.5, False, "m")
        assert s.endpoint("embed") == ("http://all", None)
        spark.conf.set("hayrick.embed_dim", "many")
        with pytest.raises(HayrickError):
            Settings.of(spark)
    finally:
        for k in ("watch_interval", "pool_expansion", "embed_dim"):
            spark.conf.unset(f"hayrick.{k}")
    with pytest.raises(HayrickError) as e:
        Settings(embed_dim=0, rerank_protocol="other")
    assert [v["field"] for v in e.value.details["violations"]] == ["rerank_protocol", "embed_dim"]


def test_texts(spark, tree, tmp_path):  # noqa: F811
    engine = Hayrick(spark, str(tmp_path / "base"), workspaces=[tree])
    assert render.answer("search", engine.search("x")).startswith("INDEX_NOT_READY")
    assert render.answer("status", engine.status()) == "index: absent"
    assert "refresh completed, epoch 1" in render.answer("index", engine.refresh())
    found = render.answer("search", engine.search("how to render a page", mode="fast"))
    assert " 1. src/widgets.py:4  Widget.render_page  [" in found
    assert "conf.go:3  function  ParseConfig" in render.answer("map", engine.map("*.go"))
    assert "index: fresh, epoch 1" in render.answer("status", engine.status())
    assert render.answer("workspaces", engine.list_workspaces()) == f"{tree}  (configured, indexed)"
    bad = render.answer("search", engine.search("x", k=0))
    assert "k: 0, accepted: integer >= 1" in bad


def test_comments_strings_and_braces():
    """What is in them declares nothing; braces that don't match make a file partial, or an error; heads go on to the body."""
    code = 'package p\n// func Not() {\n/* type Nor struct {\n*/\nvar s = "func Neither() {"\nfunc Real(\n\ta int,\n\tb int,\n) int {\n\treturn 1 // }\n}\n'
    found, status, _ = parse_source(code.encode(), "go")
    assert status == "ok" and [s["qualname"] for s in found] == ["Real"]
    assert found[0]["full_signature"] == "func Real(\n\ta int,\n\tb int,\n) int" and (found[0]["line"], found[0]["end_line"]) == (6, 11)
    assert parse_source(b"func F() {\n", "go")[1] == "partial" and parse_source(b"x }\n", "java")[1:] == ("error", "a brace closes nothing in line 1")
    rust = parse_source(b"fn f<'a>(x: &'a str) -> char {\n  '{'\n}\nfn g() {\n}\n", "rust")
    assert rust[1] == "ok" and [s["name"] for s in rust[0]] == ["f", "g"]


def test_suites_for_publication():
    suite = {"name": "s", "revision": "abc123", "cases": [{"id": 1, "expected": {"path": "acme/x.py", "qualname": "f"}}, {"id": 2, "expected": {"path": "zorb/x.py", "qualname": "f"}}]}
    with pytest.raises(HayrickError):
        evaluation.obfuscated_suite(suite, {"acme": "brick"})
    with pytest.raises(HayrickError):
        evaluation.obfuscated_suite(suite, {"abc123": "r1", "acme": "zorb"})
    assert evaluation.obfuscated_suite(suite, {"abc123": "r1", "acme": "brick"})["cases"][0]["expected"]["path"] == "brick/x.py"


def test_foreign_folders_are_left_alone(tmp_path):
    base = tmp_path / "base"
    for root in ("/r/one", "/r/two", "/r/one"):
        with Store(str(base), root).writing():
            pass
    assert Store(str(base), "/r/one").path != Store(str(base), "/r/two").path
    other = tmp_path / "other"
    other.mkdir()
    (other / "notes.txt").write_text("mine")
    with pytest.raises(HayrickError), Store(str(other), "/r/one").writing():
        pass
    assert [p.name for p in other.iterdir()] == ["notes.txt"]


def test_parsers_are_ready():
    assert preflight(sorted(PARSED)) == {}
    assert list(preflight(["cobol"])) == ["cobol"]


def test_folders_behind_links_are_not_read(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "in").mkdir(parents=True)
    outside.mkdir()
    (root / "in" / "a.py").write_text("x = 1\n")
    (outside / "b.py").write_text("secret = 1\n")
    os.symlink(outside, root / "link")
    files = spark.createDataFrame([("in/a.py",), ("link/b.py",), ("../outside/b.py",)], "path string")
    assert {r["path"]: r["content"] is not None for r in inventory.capture(files, str(root)).collect()} == {"in/a.py": True, "link/b.py": False, "../outside/b.py": False}
