import random
import re
from itertools import combinations

import pytest

from hayrick.llm import decontamination as d
from tests.llm.conftest import prose


def w(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def accepted(item, doc, window=d.WINDOW, share=d.SHARE):
    """Whether any window of any diagonal agrees enough, without a condition on seeds."""
    n = len(item)
    width = min(window, n)
    for diagonal in range(-n + 1, len(doc)):
        aligned = [0 <= diagonal + k < len(doc) and doc[diagonal + k] == item[k] for k in range(n)]
        if max(sum(aligned[s : s + width]) for s in range(n - width + 1)) >= share * width:
            return True
    return False


def brute_force(texts, items, window=d.WINDOW, share=d.SHARE):
    """Every diagonal of every pair; an item is found if a window agrees enough, whatever the seeds."""
    out = []
    for _, t in texts:
        # as the operator's words: a text that begins with a mark has an empty first word
        doc = [] if t is None else re.split(r"(?:[\W_])+", t.lower())
        wanted = [(i, w(it or "")) for i, it in items]
        out.append(sorted(i for i, item in wanted if i is not None and item and accepted(item, doc, window, share)))
    return out


@pytest.fixture(scope="module")
def items():
    return [(k, prose(500 + k, 15 + 6 * k)) for k in range(6)] + [(6, prose(700, 7)), (7, "too short"), (8, None), (None, prose(800, 20)), (9, prose(500, 15)), (10, "")]


@pytest.fixture(scope="module")
def planted(items):
    rnd, out = random.Random(1), [(0, None), (1, ""), (2, prose(1, 50))]
    for k in range(40):
        item = (items[k % 7][1]).split()
        for _ in range(k % 6):
            item[rnd.randrange(len(item))] = "swapped"
        a, b = prose(2000 + k, rnd.randint(0, 30)), prose(3000 + k, rnd.randint(0, 30))
        cut = item[: len(item) - (k % 3) * 4]
        out.append((3 + k, f"{a} {' '.join(cut)}. {b}"))
    return [*out, (3, out[3][1]), (None, items[3][1])]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_against_brute_force(spark, planted, items, limit):
    docs = spark.createDataFrame([(i, t, "x") for i, t in planted], "doc_id bigint, text string, items string").drop("items")
    found = d.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit).collect()
    least = {i: min(j for j, t in items if j is not None and t == it) for i, it in items if i is not None and it}
    expected = [(i, sorted({least[x] for x in f})) for (i, _), f in zip(planted, brute_force(planted, items), strict=True)]
    assert sorted(((r["doc_id"], r["items"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert sum(bool(x) for _, x in expected) > 15


def test_empty_sides_and_extra_columns(spark, docs, empty, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert d.contaminated(empty, bench).collect() == []
    clean = d.contaminated(docs, bench.where("false"))
    assert clean.count() == docs.count() and clean.where("size(items) > 0").isEmpty()
    assert clean.columns == [*docs.columns, "items", "overlap"]


def test_masks():
    """They begin at 0, and those of items that may differ ignore positions."""
    assert all(m[0] == 0 and list(m) == sorted(set(m)) for f in d.FAMILIES for m in f)
    assert all(m[-1] > len(m) - 1 for m in d.LONG) and d.SHORT[1] == (0, 2)


def test_no_accepted_substitution_lacks_a_seed():
    """All ways to replace words of windows of every length."""
    for n in range(1, d.WINDOW + 1):
        family, least = d.plan(n)
        counts = []
        for out in combinations(range(n), int(n * (1 - d.SHARE))):
            counts.append(sum(not any(s + k in out for k in m) for m in d.FAMILIES[family] for s in range(n - m[-1])))
        assert min(counts) == least >= 1, n


def test_rows_that_share_an_id_and_clashing_columns(spark, items):
    item = items[3][1]
    rows = [(1, item, "a", 1, 2, 3, 4), (1, prose(1, 30), "b", 1, 2, 3, 4), (None, item, "c", 1, 2, 3, 4), (None, prose(2, 30), "d", 1, 2, 3, 4), (2, item, "e", 1, 2, 3, 4), (2, item, "f", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, name string, hits int, items int, overlap int, words int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1_000_000, 0):
        found = d.contaminated(docs, bench, broadcast_rows=limit)
        assert set(found.columns) == set(docs.columns)
        assert {r["name"]: bool(r["items"]) for r in found.collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": True}


def test_texts_with_many_hits(spark):
    """More hits than a group of them has, in one long text, and items that repeat one word."""
    items = [(k, prose(100 + k, 12)) for k in range(150)] + [(900, "same " * 9)]
    texts = [(1, " ".join(t for _, t in items[:150])), (2, "same " * 40), (3, prose(7, 40))]
    found = d.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r["doc_id"]: r["items"] for r in found} == {1: list(range(150)), 2: [900], 3: []}


def test_substituted_items_are_found(spark):
    """Every fourth word of items of 1 to 60 words, and random words as many as the share allows."""
    lengths = [*range(1, 31), 60]
    items = [(n, prose(9000 + n, n)) for n in lengths]
    rnd, docs = random.Random(5), []
    for n, text in items:
        for kind in range(4):
            out = [k for k in range(n) if k % 4 == kind and n - len(range(kind, n, 4)) >= 0.75 * n]
            if not out:
                out = rnd.sample(range(n), n // 4)
            changed = [f"zz{k}" if k in out else x for k, x in enumerate(text.split())]
            docs.append((len(docs), n, " ".join([prose(9500 + n, 9), *changed, prose(9700 + kind, 9)])))
    assert all(accepted(items[lengths.index(n)][1].split(), t.split()) for _, n, t in docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.contaminated(spark.createDataFrame(docs, "doc_id bigint, n int, text string"), bench).collect()
    expected = {i: [m for m, x in items if accepted(x.split(), t.split())] for i, _, t in docs}
    assert {r["doc_id"]: r["items"] for r in found} == expected
