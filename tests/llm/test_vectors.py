"""Impact-ordered search and partial-distance clustering against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hayrick.llm import centroids, impact_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, score string, block bigint, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 0, 1, "s", 2, 3) for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(5)
    middle = [[rnd.gauss(0, 0.1) for _ in range(64)] for _ in range(6)]
    out = [(i, [m + rnd.gauss(0, 0.1) for m in middle[i % 6]]) for i in range(500)]
    out += [(600 + i, out[3][1]) for i in range(40)]  # a hot vector
    out += [(20, out[20][1]), (40, out[7][1]), (None, out[40][1]), (None, out[41][1])]
    out += [(700, None), (720, []), (740, [1.0, 2.0]), (760, [math.nan] * 64), (780, [math.inf] + [0.0] * 63), (800, [None] + [0.5] * 63), (820, [0.0] * 64), (821, [-1.0] * 64), (822, [1e7] * 64), (840, [1e4] * 64), (843, [0.1] * 70)]
    return out


def ints(x, limit=1 << 27):
    if x is None or any(c is None or not math.isfinite(c) or abs(float(np.float32(c))) * 64 >= limit for c in x):
        return None
    return [math.floor(64 * float(np.float32(c))) for c in x]


def brute_top(rows, k):
    kept = [(i, v) for i, x in rows if (v := ints(x)) is not None]
    out = []
    for at, (q, qv) in enumerate(kept):
        if q is None or q % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v, strict=False)), i is None, i or 0) for other, (i, v) in enumerate(kept) if other != at]
        out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [impact_search.BLOCK, 96])
def test_top_k_against_all_products(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(impact_search, "BLOCK", block)
    found = impact_search.top_k(frame(spark, vectors), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found), key=repr) == brute_top(vectors, 20)


def test_top_k_of_few_and_of_none(spark, vectors):
    few = vectors[:5]
    assert sorted(map(tuple, impact_search.top_k(frame(spark, few), F.col("vec_id") == 0).collect())) == [r for r in brute_top(few, 20) if r[0] == 0]
    assert impact_search.top_k(frame(spark, vectors).where("false"), F.lit(True)).count() == 0
    assert impact_search.top_k(frame(spark, vectors), F.lit(False)).count() == 0


def test_integers_of_any_size_in_another_column(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.uniform(-2.0e6, 2.0e6) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, x array<double>")
    found = sorted(map(tuple, impact_search.top_k(df, F.col("key") < 30, 7, "key", "x").collect()))
    v = [[math.floor(64 * c) for c in x] for _, x in rows]
    wanted = []
    for q in range(30):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in range(300) if i != q)
        wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:7], 1)]
    assert found == wanted


def held(x, number=0):
    rows = list(impact_search._lists(np.arange(len(x)).astype("<i8"), np.zeros(len(x), bool), np.zeros(len(x), bool), x.astype("<i4")))
    return impact_search.Block(number, len(x), rows[0][2], [(r[1], r[2]) for r in rows[1:]])


def test_search_stops_on_proof():
    """Rows near the query are proven best long before all postings are read, and the result is exact."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 8, (4000, 64))).astype(int)
    x[:60] = np.floor(x[0] + rng.normal(0, 2, (60, 64)))
    block, one = held(x), impact_search.Asked(0, 0, x[0], 20)
    one.search(block)
    exact = x @ x[0]
    order = sorted(range(1, 4000), key=lambda i: (-exact[i], i))[:20]
    assert one.best[1].tolist() == order and one.best[0].tolist() == exact[order].tolist()
    assert one.read <= 0.5 * x.size


def test_search_reads_all_where_nothing_is_proven():
    x = np.tile(np.arange(1, 65), (500, 1))
    block, one = held(x), impact_search.Asked(1 << 40, 0, x[0], 20)
    one.search(block)
    assert one.best[1].tolist() == list(range(20))


def brute_clusters(rows, clusters=16, rounds=3, width=64):
    kept = [(i, v) for i, x in rows if (v := ints(x)) is not None and len(v) == width]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [list(v) for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(middle))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for k in range(len(middle)):
            own = [v for c, (_, v) in zip(mine, kept, strict=True) if c == k]
            if own:
                middle[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    each = [sum(d for _, c, d in found if c == k) for k in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, each[c], sum(each), digest[c]) for i, c, d in found), key=repr)


def test_clusters_against_plain_loops(spark, vectors):
    found = centroids.cluster(frame(spark, vectors)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_clusters(vectors)


def test_fewer_vectors_than_clusters(spark, vectors):
    few = vectors[:5] + vectors[:2]
    assert sorted(map(tuple, centroids.cluster(frame(spark, few)).collect()), key=repr) == brute_clusters(few)
    assert centroids.cluster(frame(spark, vectors).where("false")).count() == 0


def test_other_widths_and_numbers(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice((-0.5, 0.0, 0.25)) for _ in range(5)]) for i in range(200)]  # many ties
    found = centroids.cluster(frame(spark, rows), clusters=7, rounds=2, width=5).collect()
    assert sorted(map(tuple, found), key=repr) == brute_clusters(rows, 7, 2, 5)


def test_partial_distances_save_work():
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 40, (16, 64))
    x = np.floor(middle[rng.integers(0, 16, 3000)] + rng.normal(0, 4, (3000, 64))).astype(int)
    c = np.floor(middle).astype(int)
    cluster, distance, work = centroids.assign(x, c, np.argsort(-x.var(axis=0)))
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert work < 0.25 * x.size * 16


def test_slabs_and_groups_of_any_number(spark, vectors, monkeypatch):
    """Many slabs and groups give what one task gives."""
    monkeypatch.setattr(impact_search, "BLOCK", 60)
    monkeypatch.setattr(impact_search, "LEAST_SLAB", 100)
    monkeypatch.setattr(impact_search, "QUERIES", 7)
    found = impact_search.top_k(frame(spark, vectors), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found), key=repr) == brute_top(vectors, 20)
