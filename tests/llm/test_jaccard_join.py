import random

import numpy as np
import pytest

from hayrick.llm import jaccard_join
from hayrick.llm.components import components
from tests.llm.conftest import prose


def brute_force(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                    parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(group, default=None)))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.classes(docs).collect()), key=repr) == brute_force(rows)


def test_odd_rows(spark, docs, texts, empty):
    assert sorted(map(tuple, jaccard_join.classes(docs).collect()), key=repr) == brute_force(texts)
    assert jaccard_join.classes(empty).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_all_degrees(spark, seed):
    """Groups with many copies of growing distance, and a passage that all share: chains, stars and borderline pairs."""
    rnd, rows, shared = random.Random(seed), [], prose(999, 25)
    for g in range(6):
        base = prose(1000 * seed + g, rnd.randint(20, 90))
        for _ in range(rnd.randint(1, 25)):
            w = base.split()
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(["swap", "other", "word", f"w{rnd.randrange(99)}"])
            rows.append((len(rows), " ".join(w) + (" " + shared if rnd.random() < 0.3 else "")))
    rnd.shuffle(rows)
    check(spark, rows)


def test_list_search_finds_every_pair_that_may_link():
    """Against all pairs of one list, with blocks smaller than the list."""
    rnd = np.random.default_rng(5)
    size = 300
    n = rnd.integers(20, 60, size)
    own = rnd.integers(0, 3, size)
    at = own + rnd.integers(0, 8, size)
    root = rnd.integers(0, 5, size)
    node = np.arange(size)
    met = n - own
    none = np.zeros(size, np.uint64)
    args = (node, n, at, own, root, node, np.zeros(size), met, n, none, none)
    found = {tuple(sorted(map(int, p))) for x, y in jaccard_join.search_list(*args, 80, block=16) for p in zip(x, y, strict=True)}
    expected = set()
    for i in range(size):
        for j in range(i):
            most = min(at[i] - own[i], at[j] - own[j]) + min(n[i] - at[i], n[j] - at[j])
            if root[i] != root[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and 180 * most >= 80 * (n[i] + n[j]):
                expected.add((j, i))
    assert found == expected


def test_answers_of_a_common_pivot_lose_no_pair():
    """Sets around one pivot: whatever links is found in the list of any shingle that both have."""
    rnd = random.Random(9)
    hub = frozenset(range(100))
    sets = []
    for k in range(80):
        s = set(hub) - set(rnd.sample(range(100), rnd.randint(0, 12))) | {1000 + rnd.randrange(40) for _ in range(rnd.randint(0, 8))}
        sets.append(s | {5000 + 100 * k + j for j in range(rnd.randint(0, 6))})
    n = np.array([len(s) for s in sets])
    own = np.array([sum(x >= 5000 for x in s) for s in sets])
    met = np.array([len(s & hub) for s in sets])
    far = 1 - met / (n + 100 - met)
    bits = [[sum({1 << (h & 63) for h in hub - s if (h >> 6) & 1 == k}) for s in sets] for k in (0, 1)]
    node, pivot, size = np.arange(80), np.zeros(80, int), np.full(80, 100)
    at = own  # the shared shingle comes right behind their own ones
    found = jaccard_join.search_list(node, n, at, own, node, pivot, far, met, size, *(np.array(b, np.uint64) for b in bits), 80, block=8)
    pairs = {tuple(sorted(map(int, p))) for x, y in found for p in zip(x, y, strict=True)}
    links = {(j, i) for i in range(80) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links <= pairs and 0 < len(links) < len(pairs) < 80 * 79 // 2


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    wanted = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert found == wanted
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query_against_its_sql(spark):
    from pathlib import Path

    import duckdb

    from hayrick.llm import queries

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no test tables")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted(db.execute(f"select doc_id, n_shingles, component_id from ({queries.ORACLE_SQL['op6_jaccard_join']})").fetchall())
    found = queries.QUERIES["op6_jaccard_join"](spark, sf).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == expected


def test_comparisons_are_cut_by_size(spark):
    """Sets of all sizes with one pivot or many, in chunks far smaller than their sum, give the plain intersections."""
    rnd = random.Random(4)
    nodes = {k: np.unique(np.array([rnd.randrange(400) for _ in range(rnd.choice([3, 30, 900]))], np.uint64)) for k in range(60)}
    sets = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in nodes.items()], "node bigint, shingles binary")
    pairs = [(k, 0 if k % 2 else 2 + k % 7, len(v)) for k, v in nodes.items() if k > 10]
    found = jaccard_join.compare(spark.createDataFrame(pairs, "a bigint, b bigint, n int"), sets, chunk=200).collect()
    assert sorted((r["a"], r["b"], r["shared"], r["na"], r["nb"]) for r in found) == sorted((a, b, len(np.intersect1d(nodes[a], nodes[b])), n, len(nodes[b])) for a, b, n in pairs)
