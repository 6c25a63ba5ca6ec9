import math
import random

import numpy as np
import pytest

from hayrick.llm import cotraining, licenses, toxicity
from tests.llm.conftest import prose

BAD = ["idiot", "moron", "scum", "loser"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts have bad words, poor ones marks on words."""
    rnd, rows, labels = random.Random(3), [], []
    for i in range(900):
        words, toxic, good = prose(5000 + i, rnd.randint(30, 200)).split(), i % 4 == 0, i % 5 != 0
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", sum(map(len, words))))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    labels += [labels[0], (None, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    labels = np.array(labels)
    return (order[labels == 1].mean() - (labels.sum() - 1) / 2) / (labels == 0).sum()


def test_toxicity_on_texts_not_learned_from(labelled):
    docs, labels = labelled
    found = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "text", "score").toPandas()
    held = found[found["doc_id"] % 3 == 0]
    truth = held["doc_id"] % 4 == 0
    assert auc(held["score"].to_numpy(), truth.astype(int)) > 0.9
    assert held["score"].between(0, 1).all()
    assert ((held["score"] >= toxicity.THRESHOLD) == truth).mean() > 0.85


def test_toxicity_against_the_definition(labelled):
    """Scores from the model's dictionaries by plain loops: spelling, windows, two compressors, two features."""
    import re

    import zstandard

    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert model.ordinary[:4] == model.toxic[:4] == b"\x37\xa4\x30\xec"  # trained dictionaries, not bare text
    packers = []
    for content in (model.ordinary + bytes(len(model.toxic)), model.ordinary + model.toxic):
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=3)
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def mixed(x):
        x &= (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    def score(text):
        words = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            sums = [sum((ord(c) + 1) * 0x9E3779B97F4A7C15 ** (i + 1) for i, c in enumerate(w[:k])) for k in range(1, len(w) + 1)]
            codes = [mixed(x) for x in sums[:9]] + [mixed(mixed(sums[-1]) + 1)]
            words.append(b"".join((c >> 48).to_bytes(2, "little") for c in codes))
        saved = []
        at = 0
        while words and (at == 0 or at + 16 < len(words)):
            plain, both = (len(p.compress(b"".join(words[at : at + 48]))) for p in packers)
            saved.append(plain - both)
            at += 32
        largest, mean = (max(saved) - model.tail * math.log(len(saved)), sum(s for s in saved if s > 0) / len(saved)) if saved else (0, 0)
        return 1 / (1 + np.exp(-(largest * model.weights[0] + mean * model.weights[1] + model.weights[2])))

    for r in toxicity.score(docs, model).orderBy("doc_id").limit(150).collect():
        assert abs(r["score"] - score(r["text"])) < 1e-9


def test_false_alarms_do_not_grow_with_length(spark, labelled):
    model = toxicity.train(*labelled)
    of = model.scorer()
    for words in (40, 400, 8000):
        assert sum(of(prose(70_000 + words + k, words)) >= toxicity.THRESHOLD for k in range(40)) <= 4


def test_places_of_a_word():
    assert toxicity.places("ab") == ["a", "ab", "ab "]
    assert toxicity.places("abcdefghijkl") == [*("abcdefghi"[:k] for k in range(1, 10)), "abcdefghijkl "]


def test_toxicity_of_odd_rows(labelled, docs, empty):
    model = toxicity.train(*labelled)
    found = toxicity.score(docs, model)  # its own column score is replaced
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").isEmpty()
    blank = {r["score"] for r in found.where("text is null or trim(text) = ''").collect()}
    assert len(blank) == 1
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.train(docs, labelled[1].where("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_ids_labels_and_metadata_are_no_inputs(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    plain = toxicity.score(docs, model).select("text", "score")
    moved = toxicity.score(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'yy' as source", "n_chars"), model).select("text", "score")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, moved.collect()))


def test_co_training(labelled, docs, empty):
    texts, labels = labelled
    model = cotraining.train(texts, labels)
    found = cotraining.score(texts, model).toPandas()
    held = found[found["doc_id"] % 3 == 0]
    assert auc(held["score"].to_numpy(), (held["doc_id"] % 5 != 0).astype(int)) > 0.95
    odd = cotraining.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or isnan(score)").isEmpty()
    assert cotraining.score(empty, model).collect() == []
    lost = cotraining.train(texts, labels.where("false"))
    assert {r["score"] for r in cotraining.score(docs, lost).collect()} == {1.0}
    nulls = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars")
    assert cotraining.score(nulls, model).where("score is null").isEmpty()


def test_views_are_the_same_in_any_batch():
    import pyarrow as pa

    table = pa.table({"text": ["a b b\nc", None, "", "ÄÖ 12!!"], "lang": ["en", None, "de", "en"], "source": ["x", "y", None, "x"], "n_chars": [7, 0, 0, 7]})
    whole = cotraining.views(table)
    for k in range(4):
        part = cotraining.views(table.slice(k, 1))
        assert all(np.allclose(w[k], p[0]) for w, p in zip(whole, part, strict=True))


@pytest.fixture(scope="module")
def licensed(spark):
    """Notices among prose, cut short, in other case, and sentences that only talk of licences."""
    rows = [(0, None, []), (1, "", []), (2, prose(1, 3000), []), (3, "We discussed the license of the photo yesterday.", []), (4, "The general public is invited to the free event.", [])]
    flat = [(f, t) for f, ts in licenses.NOTICES.items() for t in ts]
    for k, (family, notice) in enumerate(flat):
        rows.append((10 + k, f"{prose(k, 20)}\n{notice}\n{prose(k + 50, 20)}", [family]))
        rows.append((110 + k, notice.upper() if k % 2 else notice.rstrip("."), [family]))
    both = sorted(["MIT", "GPL"])
    rows.append((300, f"{flat[0][1]}\n\n{prose(7, 10)}\n{licenses.NOTICES['GPL'][0]}", both))
    return rows + [rows[5]] + [(400 + k, prose(400 + k, 40), []) for k in range(60)]


def test_licences(spark, licensed, docs, empty):
    table = spark.createDataFrame([(i, t) for i, t, _ in licensed], "doc_id bigint, text string").repartition(3)
    model = licenses.train(table)
    found = licenses.scan(table, model).collect()
    assert sorted((r["doc_id"], tuple(r["licences"])) for r in found) == sorted((i, tuple(e)) for i, _, e in licensed)
    odd = licenses.scan(docs, model)
    assert odd.count() == docs.count() and set(docs.columns) < set(odd.columns)
    assert licenses.scan(empty, model).collect() == []


def test_prose_on_licences_is_no_licence(spark, licensed):
    """Lines that speak of licences are learned as ordinary text, not left out; none is taken for one, and texts' own paragraphs are."""
    talk = ["Her driving license had expired, and the public copyright office was closed.", "They argued about the terms of the license fee and who may use the file.", "A general license for the library costs more than the software.", "Copyright law is dull, said the author, and the notice was lost.", "The creative commons of the village were open to any person free of charge."]
    rows = [(i, t) for i, t, _ in licensed] + [(1000 + k, f"{prose(k, 12)}\n{talk[k % 5]}\n{prose(k + 50, 9)}") for k in range(80)]
    body = "\n".join(licenses.NOTICES["BSD"][2:])
    rows += [(2000, body), (2001, licenses.NOTICES["AGPL"][1]), (2002, "\n".join(licenses.NOTICES["zlib"][1:]))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(table, licenses.train(table)).collect()}
    assert all(found[1000 + k] == [] for k in range(80))
    assert (found[2000], found[2001], found[2002]) == (["BSD"], ["AGPL"], ["zlib"])


def test_licence_scores_against_plain_python(spark, licensed):
    import re

    table = spark.createDataFrame([(i, t) for i, t, _ in licensed], "doc_id bigint, text string")
    model = licenses.train(table)
    weights = {r["ngram"]: r for r in model.weights.collect()}
    lines = [t for ts in licenses.NOTICES.values() for t in ts]
    scored = {r["line_"]: r for r in model.scored(spark.createDataFrame([(x, x) for x in lines], "line_ string, line string"), ["line_"]).collect()}
    for line in lines:
        words = [x for x in re.split(r"[\W_]+", line.lower())]
        grams = {g for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))] if g in weights}
        z = np.array(model.intercepts) + sum(np.array(weights[g]["weights"]) for g in grams)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert scored[line]["family"] == licenses.FAMILIES[int(z.argmax())]
        assert abs(scored[line]["probability"] - p.max()) < 1e-9


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def test_wrapped_notices(spark, licensed):
    import textwrap

    rows = []
    for k, (family, text) in enumerate(WRAPPED.items()):
        for width in (30, 70, 75, 80):
            for mark in ("", " * ", "# "):
                body = "\n".join(mark + x for x in textwrap.wrap(text, width))
                rows.append((len(rows), f"{prose(60 + k, 20)}\n{body}\n{prose(90 + k, 20)}", [family]))
    rows.append((len(rows), "\n\n".join(textwrap.fill(WRAPPED[f], 72) for f in ("MIT", "GPL")), ["GPL", "MIT"]))
    rows.append((len(rows), "\n".join(textwrap.fill(WRAPPED[f], 72) for f in ("MIT", "GPL")), ["GPL", "MIT"]))
    rows.append((len(rows), textwrap.fill("We discussed the license of the photo, and whether this program is free of charge to any person in the general public.", 40), []))
    model = licenses.train(spark.createDataFrame([(i, t) for i, t, _ in licensed], "doc_id bigint, text string").repartition(3))
    found = licenses.scan(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), model).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == {i: e for i, _, e in rows}
    assert all(r["n_paragraphs"] == len(r["licences"]) and not r["n_unconfirmed"] for r in found)


def test_notices_far_down_in_long_texts(spark, licensed):
    """Places beyond 2,147 words of a block, where a product of whole numbers of 32 bits overflowed, and very many blank lines, which exhausted the stack of a task."""
    import textwrap

    body = textwrap.fill(WRAPPED["BSD"], 40)
    rows = [(k, f"{prose(k, words)}\n{body}\n{prose(k + 5, 30)}", ["BSD"]) for k, words in enumerate((2000, 2200, 5000, 30_000))]
    blank = "\n" + " \n" * 60_000
    rows.append((10, f"{licenses.NOTICES['MIT'][1]}{blank}{body}", ["BSD", "MIT"]))
    model = licenses.train(spark.createDataFrame([(i, t) for i, t, _ in licensed], "doc_id bigint, text string").repartition(3))
    found = licenses.scan(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), model).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == {i: e for i, _, e in rows}


def test_co_training_sees_all_unlabelled_documents(spark):
    """The surest documents and the statistics are those of all rows, more than any sample held."""
    rnd = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(k)), "en", "s", 5 * int(k)) for i, k in enumerate(rnd.integers(1, 30, 6000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    features = cotraining.featured(docs)
    local = cotraining.views(docs.toArrow())
    centre = cotraining.centres(features)
    for x, (m, s) in zip(local, centre, strict=True):
        assert np.allclose(m, x.mean(0), atol=1e-5) and np.allclose(s, x.std(0) + 1e-6, atol=1e-4)
    weights = [np.zeros(x.shape[1] + 1) for x in local]
    weights[0][12] = 1.0  # log of the count of words
    known = spark.createDataFrame([(i,) for i in range(100)], "doc_id bigint")
    plain = [(np.zeros(x.shape[1]), np.ones(x.shape[1])) for x in local]
    found = cotraining.surest(features, known, weights, plain, [[], []], (5, 40), 0.9)
    length = {r["key"]: r["doc_id"] for r in features.select("key", "doc_id").collect()}
    ids = [length[r["key"]] for r in found]
    assert len(ids) == 40 and {r["slot"] for r in found} == {1} and min(ids) >= 100
    sizes = sorted((len(t.split()) for i, t, *_ in rows if i >= 100), reverse=True)
    assert sorted((len(rows[i][1].split()) for i in ids), reverse=True) == sizes[:40]


def test_licence_model_learns_from_every_paragraph(spark):
    """Talk of licences in 100 of 900 documents, none of them among the 400 with the smallest hashes, which were the sample."""
    talk = "Her driving license and the copyright notice were in the office."
    ids = [r["id"] for r in spark.range(900).selectExpr("id", "xxhash64(cast(id as string)) as h").orderBy("h", "id").collect()]
    rows = [(k, "\n".join([prose(k, 6)] * 30 + ([talk] if k in set(ids[-100:]) else []))) for k in ids]
    model = licenses.train(spark.createDataFrame(rows, "doc_id bigint, text string"), common_share=0.003)
    known = {r["ngram"] for r in model.weights.select("ngram").collect()}
    assert {"license", "copyright", "notice"} & known == set()  # 100 of 27,100 paragraphs, more than the share
