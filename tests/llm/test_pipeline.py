"""The pipeline on a small table, stage by stage against plain Python."""

import itertools
import zlib

import numpy as np
import pytest

import corpus_pipeline
from hayrick.llm import jaccard_join, packing, secrets, tokens, toxicity
from tests.llm.conftest import prose
from tests.llm.test_decontamination import brute_force as decontaminated
from tests.llm.test_jaccard_join import brute_force as joined

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_of_groups(rows):
    """Of connected rows, told apart by their place in the list, one; rows without words all stay."""
    groups = [g for _, _, g in joined_groups([t for _, t in rows])]
    out = []
    for g in sorted(set(groups) - {None}):
        members = [r for r, h in zip(rows, groups) if h == g]
        least = min((i for i, _ in members if i is not None), default=None)
        out.append((least, {t for i, t in members if i == least}))
    return out, [r for r, h in zip(rows, groups) if h is None]


def joined_groups(texts):
    """(place, text, number of its group) by all pairs; None without words."""
    rows = joined([(k, t) for k, t in enumerate(texts)])
    return [(k, texts[k], component if size else None) for k, size, component in sorted(rows)]


def check_kept(before, after):
    groups, blank = kept_of_groups(before)
    left = list(after)
    for row in blank:
        left.remove(row)
    assert len(left) == len(groups)
    for least, options in groups:
        (mine,) = [r for r in left if r[0] == least and r[1] in options][:1] or [None]
        assert mine is not None
        left.remove(mine)
    assert not left


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(240):
        words = prose(9000 + i, 40 + i % 90).split()
        if i % 6 == 0:
            words[5::9] = ["scum"] * len(words[5::9])
        if i % 10 == 3:
            words = [*words, "token", "=", f'"{zlib.crc32(str(i).encode()):08x}{zlib.adler32(str(i * 7).encode()):08x}deadbeef0123"']
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(words)))
    items = [(k, prose(600 + k, 30)) for k in range(4)]
    rows += [(300 + k, f"{prose(70 + k, 20)} {items[k][1]} {prose(80 + k, 20)}") for k in range(4)]
    rows += [(400 + k, rows[20 + k][1]) for k in range(10)] + [(500 + k, rows[40 + k][1] + " more") for k in range(10)]
    rows += [(600, None), (601, ""), (602, prose(1, 20_000)), (7, rows[7][1])]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages(spark, tables):
    folder, items = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near copies", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    of, before = model.scorer(), pairs(docs)
    now = stages["toxicity"](spark, docs, folder)
    assert now.columns == COLUMNS
    assert sorted(pairs(now), key=repr) == sorted((r for r in before if of(r[1] or "") < toxicity.THRESHOLD), key=repr)
    assert 0 < now.count() < docs.count()

    before = pairs(now)
    now = stages["near copies"](spark, now, folder)
    assert now.columns == COLUMNS
    check_kept(before, pairs(now))
    assert not {400, 401} & {i for i, _ in pairs(now)}

    before = pairs(now)
    now = stages["decontamination"](spark, now, folder)
    assert now.columns == COLUMNS
    assert sorted(pairs(now), key=repr) == sorted((r for r, found in zip(before, decontaminated([(i, t or "") for i, t in before], items), strict=True) if not found), key=repr)

    field = secrets.train(now)
    before = now.collect()
    now = stages["secrets"](spark, now, folder)
    assert now.columns == COLUMNS
    after = {r["doc_id"]: r for r in now.collect()}
    for r in before:
        text = r["text"]
        if text is not None:
            hidden = [False] * len(text)
            for _, a, b in secrets.spans_of(text, field):
                hidden[a:b] = [True] * (b - a)
            runs = itertools.groupby(zip(text, hidden), key=lambda c: c[1])
            text = "".join("[secret]" if on else "".join(c for c, _ in run) for on, run in runs)
        assert after[r["doc_id"]]["text"] == text
        assert after[r["doc_id"]]["n_chars"] == (len(text) if text is not None else r["n_chars"])

    packed = stages["packing"](spark, now, folder).collect()
    encoder = tokens.Encoder.of(tokens.tokenizer_path())
    total = 0
    for i, r in after.items():
        ids = np.array([*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        total += len(ids)
        for p in (p for p in packed if p["doc_id"] == i):
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]])
    assert sum(p["length"] for p in packed) == total


def test_run(spark, tables):
    folder, _ = tables
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100


NEAR = " ".join(["changed" if k == 20 else w for k, w in enumerate(prose(31, 120).split())])


@pytest.mark.parametrize("most", [corpus_pipeline.SPARE_ROWS, 0])
def test_near_copies_go_by_row(spark, monkeypatch, most):
    """Rows that share an id are told apart, joined by broadcast or not."""
    monkeypatch.setattr(corpus_pipeline, "SPARE_ROWS", most)
    x, y = prose(31, 120), prose(32, 60)
    rows = [(3, x), (5, y), (5, NEAR), (None, NEAR), (None, prose(33, 50)), (None, prose(33, 50)), (7, y), (7, y), (8, prose(34, 40)), (8, prose(34, 40)), (9, None), (9, None), (10, ""), (11, " "), (12, "one word"), (13, "one word")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id bigint, text string, mark int, times int, kept int, component_id int").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in out.collect()]
    check_kept(rows, found)
    assert (5, NEAR) not in found and (3, x) in found and found.count((8, prose(34, 40))) == 1 and found.count((9, None)) == 2
    assert jaccard_join.spare(docs.where("false")).collect() == []


def test_stages_of_odd_tables(spark, tables):
    """Empty tables, null columns, and columns named as what the operators make."""
    folder, _ = tables
    extra = "cast(null as double) as score, 'x' as spans, 1 as hits, 2 as items, 3 as overlap, 4 as kept, 5 as bucket, 6 as length"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (2, prose(5, 30), None, None, 9), (None, prose(6, 30), "en", None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *extra.split(", "))
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name == "packing":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns
                assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
