import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from hayrick.api import Hayrick
from hayrick.errors import HayrickError, check_limit, check_search
from hayrick.jobs import Jobs
from hayrick.plans import evaluation, index, search
from hayrick.sources import inventory, suites
from hayrick.sources.store import Store, indexed_roots, profile_of
from hayrick.sources.symbols import parse, parse_source


def write(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    os.makedirs(root)
    write(root, "src/widgets.py", 'class Widget:\n    """A widget of the page."""\n\n    def render_page(self, depth):\n        return "rendered page"\n\n\ndef helper(x):\n    return x\n')
    write(root, "tests/test_widgets.py", "def test_render_page():\n    assert render_page\n")
    write(root, "conf.go", "package conf\n\nfunc ParseConfig(p string) int {\n\treturn 1\n}\n\ntype Settings struct {\n\tA int\n}\n")
    write(root, "notes.txt", "not code")
    subprocess.run("git init -q . && git add -A && git -c user.name=a -c user.email=a@b.c commit -qm x", shell=True, cwd=root, check=True)
    return root


@pytest.mark.parametrize(
    ("lang", "source", "expected"),
    [
        ("python", "class A:\n    def f(self):\n        def g(): pass\n", [("A", "class"), ("A.f", "function"), ("A.f.g", "function")]),
        ("go", "package p\nfunc (r *R) M() {\n}\nfunc F() {\n}\ntype S struct {\n}\ntype I interface {\n}\ntype T = int\n", [("M", "method"), ("F", "function"), ("S", "struct"), ("I", "interface"), ("T", "type_alias")]),
        ("rust", "struct P;\nimpl P {\n  pub fn new() -> P {\n  }\n}\ntrait T {\n}\nenum E {\n}\n", [("P", "struct"), ("P", "impl"), ("P.new", "function"), ("T", "trait"), ("E", "enum")]),
        ("java", "public class A {\n  public int size() {\n    return 1;\n  }\n}\ninterface B {\n}\n", [("A", "class"), ("A.size", "method"), ("B", "interface")]),
        ("typescript", "export class A {\n  run(x: number): void {\n  }\n}\ninterface I {\n}\nenum E {\n}\ntype T = string;\nfunction f() {\n}\n", [("A", "class"), ("A.run", "method"), ("I", "interface"), ("E", "enum"), ("T", "type_alias"), ("f", "function")]),
        ("ruby", "module M\n  class A\n    def go\n    end\n  end\nend\n", [("M", "module"), ("M.A", "class"), ("M.A.go", "method")]),
        ("c", "struct s {\n  int a;\n};\nint main(int argc) {\n  return 0;\n}\n", [("s", "struct"), ("main", "function")]),
        ("csharp", "class A {\n  public void Go() {\n  }\n}\n", [("A", "class"), ("A.Go", "method")]),
        ("php", "<?php\nclass A {\n  public function go() {\n  }\n}\nfunction f() {\n}\n", [("A", "class"), ("A.go", "method"), ("f", "function")]),
        ("cpp", "class A {\n};\nint f(int x) {\n  return x;\n}\n", [("A", "class"), ("f", "function")]),
    ],
)
def test_symbols_by_language(lang, source, expected):
    found, status, _ = parse_source(source.encode(), lang)
    assert status == "ok" and [(s["qualname"], s["kind"]) for s in found] == expected


def test_parse_statuses(spark):
    files = [("a.py", b"def f(:\n  pass\ndef g(): pass\n"), ("b.py", b"x = (\n"), ("c.py", b"x = 1\n"), ("d.txt", b"?"), ("e.py", None), ("f.py", b"def f():\n    'doc'\n    return '\xff'\n")]
    rows = parse(spark.createDataFrame(files, "path string, content binary"))
    assert {r["path"]: r["status"] for r in rows.where(F.col("qualname").isNull()).collect()} == {"a.py": "partial", "b.py": "error", "c.py": "empty", "d.txt": "unsupported", "e.py": "unreadable", "f.py": "ok"}
    f = rows.where("path = 'f.py' and qualname = 'f'").first()
    assert (f["line"], f["end_line"], f["docstring"], f["full_signature"]) == (1, 3, "doc", "def f():")


def test_inventory(spark, tree):
    os.symlink("widgets.py", os.path.join(tree, "src/link.py"))
    write(tree, "big.py", "x" * 1_000_001)
    write(tree, "fresh.py", "x = 1\n")
    assert sorted(r["path"] for r in inventory.inventory(spark, tree).collect()) == ["conf.go", "fresh.py", "src/widgets.py", "tests/test_widgets.py"]
    here = inventory.inventory(spark, tree)
    assert [r["path"] for r in inventory.scoped(here, tree, ["conf.go", "../x.py", "/etc/a.py"]).collect()] == ["conf.go"]
    assert [r[0] for r in inventory.languages(here).collect()] == ["go", "python"]
    gone = spark.createDataFrame([("fresh.py",), ("nothing.py",), ("src/link.py",)], "path string")
    assert {r["path"]: r["content"] is not None for r in inventory.capture(gone, tree).collect()} == {"fresh.py": True, "nothing.py": False, "src/link.py": False}
    with pytest.raises(HayrickError):
        inventory.root_of("/")


def test_refreshes(spark, tree, tmp_path):
    store = Store(str(tmp_path / "base"), tree)
    with pytest.raises(HayrickError) as e:
        search.search(spark, store, "x")
    assert e.value.code == "INDEX_NOT_READY"
    assert index.refresh(spark, store, tree)["files"] == 3
    assert index.refresh(spark, store, tree)["files"] == 0
    assert index.refresh(spark, store, tree, rebuild=True)["files"] == 3
    before = store.read(spark, "symbols", 1)
    n = before.count()
    write(tree, "src/widgets.py", "def broken(:\n")
    os.remove(os.path.join(tree, "conf.go"))
    done = index.refresh(spark, store, tree)
    assert done["statuses"] == {"partial": 1} or done["statuses"] == {"error": 1}
    assert done["removed"] == 1 and before.count() == n  # an old epoch stays as it was
    write(tree, "src/widgets.py", "x = (\n")
    assert index.refresh(spark, store, tree)["statuses"] == {"error": 1}
    assert index.refresh(spark, store, tree)["statuses"] == {"error": 1}  # tried again
    assert index.refresh(spark, store, tree, cancelled=lambda: True)["state"] == "cancelled"
    assert index.status(spark, store, tree)["freshness"] == "stale"
    assert indexed_roots(str(tmp_path / "base")) == [tree]
    other = Store(str(tmp_path / "base"), tree, profile_of("m/x", 4))
    with pytest.raises(HayrickError) as e:
        other.epoch()
    assert e.value.code == "INDEX_PROFILE_MISMATCH"
    write(tree, "src/widgets.py", "def whole():\n    pass\n")
    done = index.refresh(spark, other, tree)  # a writer with another profile begins anew
    assert done["files"] == 2 and other.epoch() == 1 and profile_of() != profile_of("m/x", 4) != profile_of("m/x", 5)
    with pytest.raises(HayrickError):
        store.epoch()


def embedder(texts, query):
    return [[float(len(t) % 7), 1.0, float("page" in t), 0.5] for t in texts], None


def test_search(spark, tree, tmp_path):
    store = Store(str(tmp_path / "base"), tree)
    index.refresh(spark, store, tree)
    exact = search.search(spark, store, "Widget", 5)
    assert exact.stages == ["exact"] and [r["qualname"] for r in exact.results] == ["Widget"]
    hidden = search.search(spark, store, "helper", 5, intent="tests")
    assert "exact" not in hidden.stages and all(r["source_role"] == "test" for r in hidden.results)
    fast = search.search(spark, store, "how to render a page", 5, mode="fast", embed=embedder)
    assert fast.stages == ["lexical"] and not fast.reasons and fast.results[0]["qualname"] == "Widget.render_page"
    assert [r["id"] for r in search.search(spark, store, "how to render a page", 2, mode="fast").results] == [r["id"] for r in fast.results[:2]]
    part = search.search(spark, store, "how to render a page", 5, embed=embedder)
    assert part.stages == ["lexical", "dense"] and part.reasons == ["DENSE_INDEX_PARTIAL"]
    cache = index.embed_missing(store, spark, embedder)
    done = index.attach_vectors(spark, store, cache, 4)
    assert done["attached"] == store.read(spark, "symbols").count() and done["missing"] == 0
    whole = search.search(spark, store, "how to render a page", 5, embed=embedder)
    assert whole.reasons == []
    lost = search.search(spark, store, "how to render a page", 5, embed=lambda t, q: (None, "down"))
    assert lost.reasons == ["QUERY_MODEL_UNAVAILABLE"] and lost.warnings == ["down"]
    turned = search.search(spark, store, "how to render a page", 50, rerank=lambda q, d: ([(i, float(i)) for i in range(len(d))], None), intent="any")
    straight = search.search(spark, store, "how to render a page", 50, rerank=lambda q, d: ([(i, -float(i)) for i in range(len(d))], None), intent="any")
    assert "rerank" in turned.stages and [r["id"] for r in turned.results] == [r["id"] for r in straight.results][::-1]
    bad = search.search(spark, store, "how to render a page", 5, rerank=lambda q, d: ([(0, 1.0)], None))
    assert bad.reasons == ["RERANK_FALLBACK"]
    slow = search.search(spark, store, "how to render a page", 5, rerank=lambda q, d: time.sleep(0.1) or (None, None), deadline=0.0)
    assert slow.reasons == ["DEADLINE_FALLBACK", "RERANK_FALLBACK"]


def test_requests():
    with pytest.raises(HayrickError) as e:
        check_search(True, "quick", "all")
    assert [v["field"] for v in e.value.details["violations"]] == ["k", "mode", "intent"]
    check_search(1, "deep", "tests")
    for bad in (0, 501, True, "1"):
        with pytest.raises(HayrickError):
            check_limit(bad)
    assert not search.valid_reply([(0, 1.0), (True, 1.0)], 2) and search.valid_reply([(1, 1), (0, 0.5)], 2)


def test_api_and_jobs(spark, tree, tmp_path):
    engine = Hayrick(spark, str(tmp_path / "base"), workspaces=[tree])
    assert engine.search("Widget")["error"]["code"] == "INDEX_NOT_READY"
    job = engine.refresh()["data"]
    assert job["state"] == "completed" and job["epoch"] == 1 and job["lexical_ready"]
    assert engine.search("Widget")["data"]["results"][0]["name"] == "Widget"
    page = engine.map("*.py", limit=2)["data"]
    assert len(page["symbols"]) == 2 and page["next"] == 2
    assert engine.map(limit=0)["error"]["code"] == "INVALID_ARGUMENT"
    assert engine.status()["data"]["freshness"] == "fresh"
    assert engine.job("none")["error"]["code"] == "JOB_NOT_FOUND"
    assert engine.search("x", repo="/nowhere")["error"]["code"] == "REPOSITORY_NOT_FOUND"
    assert engine.list_workspaces()["data"]["workspaces"] == [{"root": tree, "configured": True, "indexed": True}]
    assert Hayrick(spark, str(tmp_path)).status()["error"]["code"] == "REPOSITORY_NOT_SELECTED"
    assert engine.journal.jobs().first()["state"] == "completed"


def test_jobs_join_cancel_and_fail():
    import threading

    gate = threading.Event()

    def run(job, cancelled):
        gate.wait(10)
        if job.mode == "rebuild":
            raise RuntimeError("boom")
        return {"state": "cancelled"} if cancelled() else {"state": "completed", "epoch": 3}

    jobs = Jobs(run)
    first, how = jobs.submit("r")
    again, joined = jobs.submit("r")
    other, fresh = jobs.submit("r", paths=["b", "a", "b"])
    failing, _ = jobs.submit("r", "rebuild")
    assert (how, joined, fresh) == ("started", "joined", "started") and again is first and other.paths == ("a", "b")
    jobs.cancel(other.job_id)
    gate.set()
    for job in (first, other, failing):
        assert job.done.wait(10)
    assert (first.state, other.state, failing.state) == ("completed", "cancelled", "failed") and first.epoch == 3
    with pytest.raises(HayrickError):
        jobs.get(first.job_id, "another")


def test_suites_and_replays(spark, tree, tmp_path):
    store = Store(str(tmp_path / "base"), tree)
    index.refresh(spark, store, tree)
    path = tmp_path / "suite.json"
    path.write_text('{"name": "s", "revision": "r", "cases": [{"id": "a", "query": "render a page", "expected": {"path": "src/widgets.py", "qualname": "Widget.render_page"}, "rationale": ""}]}')
    cases = suites.suite(spark, f"file://{path}")
    report = evaluation.run_suite(spark, store, cases)
    assert report["recall"] == 1.0 and report["mrr"] == 1.0 and report["loss_stages"] == {}
    assert report["cases"]["a"] == {"rank": 1, "loss_stage": None, "retrieved_by": ["fts"]} and report["coverage"]["parse_coverage"] == {"ok": 3}
    with pytest.raises(HayrickError):
        evaluation.gold_ids(cases.withColumn("gold_path", F.lit("x")), store.read(spark, "symbols"))
    pools = tmp_path / "pools.json"
    pools.write_text('{"cases": [{"id": "a", "query": "q", "pool": [{"path": "x", "qualname": "f", "score": 0.5}, {"path": "y", "qualname": "g", "score": 0.4}]}]}')
    again = evaluation.replay(suites.saved_pools(spark, f"file://{pools}"), lambda q, d: ([(1, 0.9), (0, 0.1)], None), "signature")
    assert [r["qualname"] for r in again.orderBy("new_rank").collect()] == ["g", "f"]
    pools.write_text('{"redacted": true, "cases": []}')
    with pytest.raises(HayrickError):
        suites.saved_pools(spark, f"file://{pools}")
    assert evaluation.obfuscate({"Acme": ["ACME acme acmeX"], "issue_url": 1}, {"acme": "zorb"}) == {"Zorb": ["ZORB zorb zorbX"]}


def test_a_batch_is_what_single_searches_give(spark, tree, tmp_path):
    """Ranks of all cases of a suite, with models, against one search a case; and where cases are lost."""
    store = Store(str(tmp_path / "base"), tree)
    index.refresh(spark, store, tree)
    index.attach_vectors(spark, store, index.embed_missing(store, spark, embedder), 4)
    asked = {"a": ("how to render a page", "src/widgets.py", "Widget.render_page"), "b": ("parse config of settings", "conf.go", "ParseConfig"), "d": ("zzz nothing of that kind", "conf.go", "Settings")}
    cases = spark.createDataFrame([(i, q, p, n, "") for i, (q, p, n) in asked.items()], "id string, query string, gold_path string, gold_qualname string, rationale string")
    for models in ({"embed": embedder}, {"rerank": lambda q, d: ([(i, -float(i)) for i in range(len(d))], None)}):
        report = evaluation.run_suite(spark, store, cases, k=1, intent="any", **models)
        for i, (query, path, name) in asked.items():
            found = [(r["path"], r["qualname"]) for r in search.search(spark, store, query, 500, intent="any", **models).results]
            rank = found.index((path, name)) + 1 if (path, name) in found else None
            assert report["cases"][i]["rank"] == rank, (i, models)
            assert report["cases"][i]["loss_stage"] == (None if rank == 1 else "ranked_deep" if rank else "not_retrieved")
        assert ("dense" in report["cases"]["a"]["retrieved_by"]) == ("embed" in models)
