"""The filter audit against plain loops over documents, orders and steps."""

import re
from itertools import permutations

import pytest

from hayrick.llm import filter_audit


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        ("A" if len(words) < 100 else "")
        + ("B" if 100 * len(set(words)) < 80 * len(words) else "")
        + ("C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else "")
        + ("D" if re.search(r"[#$%&*|]", text) else "")
    )


def brute(rows, labels):
    """Every document walks through every order."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        repeated = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        docs.append((lang or "", failures(text) + "E" * repeated, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = [d for d in mine if letter in d[1]]
                removed_in_all[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == letter for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_in_all[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def rows():
    plain = " ".join(f"w{i}" for i in range(120))
    loud = " ".join(f"W{i}A" for i in range(130))
    out = [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b\x0c\r ", None), (4, plain, "en"), (5, plain, "de"), (6, plain, "en"), (6, plain, "en"), (7, loud, ""), (8, "a b " * 90, "de"), (9, "a # b", "de")]
    out += [(10, plain + " $", "en"), (11, loud + " |", "de"), (12, "É ü ß " * 40, "en"), (13, "AB " * 60 + "c d " * 40, "fr"), (14, ("x" * 50 + " ") * 40_000, "fr")]
    out += [(None, plain, "en"), (None, plain, "en"), (None, None, None), (20, "99 words " * 49 + "and", "en"), (21, " ".join(f"v{i}" for i in range(99)), "en"), (22, " ".join(f"v{i}" for i in range(100)), "en")]
    return out + [(30 + i, plain, "en") for i in range(40)]  # a hot text


def table(spark, rows):
    full = [(i, t, lang, 7, "x", 1.0) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, mask int, digest string, first double").repartition(3)


LABELS = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (6, 0, 1), (9, 1, None), (10, None, 1), (14, 1, 1), (None, 1, 1), (33, 1, 0), (999, 1, 1)]


def test_against_plain_loops(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(table(spark, rows), labels).collect()}
    assert found == brute(rows, LABELS)
    assert len(found) == 600 * 4


def test_without_labels_and_without_documents(spark, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = filter_audit.audit(table(spark, rows[:1]), none)
    assert {(r["good_lost"], r["toxic_lost"]) for r in one.collect()} == {(0, 0)} and one.count() == 600
    assert filter_audit.audit(table(spark, rows).where("false"), none).count() == 0


def test_shares_of_all_orders_add_up(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    out = filter_audit.audit(table(spark, rows), labels).where("part = 'en'").collect()
    assert {r["shapley"] for r in out if r["filter_order"][r["step"] - 1] == "E"} == {sum(r["removed"] for r in out if r["filter_order"][r["step"] - 1] == "E")}


def test_no_python_in_the_plan(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    masks = filter_audit.masked(table(spark, rows), filter_audit.text_failures(filter_audit.common.whole_text()), filter_audit.F.col("lang"))
    plan = filter_audit.cells(masks, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
