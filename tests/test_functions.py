import re

import pytest
from pyspark.sql import functions as F

from hayrick.functions import roles, text, vectors
from hayrick.functions.porter import porter


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("path", "role"),
    [("", "unknown"), ("/", "unknown"), ("conftest.py", "fixture"), ("src/app/main.py", "production"), ("tests/test_x.py", "test"), ("pkg/x_test.go", "test"), ("web/a.spec.ts", "test"), ("tests/fixtures/a.py", "fixture"), ("testdata/a.go", "fixture"), ("api/v1.pb.go", "generated"), ("gen/a.py", "generated"), ("examples/run.py", "example"), ("src/demo.py", "example"), ("src/contest.py", "production"), ("src/latest.py", "production")],
)
def test_roles(spark, path, role):
    assert value(spark, roles.source_role(F.lit(path))) == role


def test_languages(spark):
    for path, lang in (("a/b.py", "python"), ("x.tsx", "tsx"), ("x.PY", None), ("noext", None), ("d.dir/file", None), ("h.h", "c")):
        assert value(spark, roles.language_of(F.lit(path))) == lang


def spoken(query):
    out = []
    for token in re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", query):
        parts = re.findall(text.CAMEL, token.replace("_", " "))
        if len(parts) > 1 and " ".join(parts).lower() != token.lower():
            out.append(" ".join(parts))
    return out[:8]


@pytest.mark.parametrize("query", ["parseHTTPResponse2JSON now", "sample.py", "snake_case_name and CamelCase", "plain words", "", "A_b aB __x__", " ".join(f"fooBar{i}" for i in range(12))])
def test_variants(spark, query):
    assert value(spark, text.lexical_variants(F.lit(query))) == spoken(query)


def test_query_lists(spark):
    assert value(spark, text.query_list(F.lit("sample.py"))) == ["sample.py", "sample py"]
    greedy = F.array(*[F.lit(f"v{i}") for i in range(50)])
    found = value(spark, text.query_list(F.lit("raw"), greedy))
    assert len(found) == 8 and found[0] == "raw"
    assert len(value(spark, text.query_list(F.lit(" ".join(f"fooBar{i}" for i in range(12)))))) == 9


def test_terms_are_unicode(spark):
    assert value(spark, text.match_terms(F.lit("Größe x ab ab"))) == ["Größe", "ab", "ab"]
    assert value(spark, text.distinct_terms(F.lit("Foo foo_bar FOO xy"))) == ["foo", "foo_bar"]
    assert value(spark, text.term_hits(F.lit("the größe of foobar"), F.array(*map(F.lit, ["größe", "foo", "bar", "roße"])))) == 2
    assert value(spark, text.index_tokens(F.lit("foo_Bar é9"))) == ["foo", "bar", "é9"]


def bounded(body, n):
    if n <= 0 or len(body) <= n:
        return "" if n <= 0 else body
    kept = body[:n]
    cut = kept.rfind("\n")
    kept = kept[:cut] if cut > 0 else kept
    skipped = len(body.splitlines()) - len(kept.splitlines())
    return f"{kept}\n… (+{skipped} lines)" if skipped > 0 else f"{kept}\n…"


@pytest.mark.parametrize("body", ["", "short", "a\nb\nc\nd\ne\nf", "\nabcdefghijk", "abcdefghijklmn\nx", "abcdefghijklmnop", "ab\n\n\n\n\n\n\n\n\n"])
@pytest.mark.parametrize("n", [0, 3, 8, 100])
def test_bounded_body(spark, body, n):
    assert value(spark, text.bounded_body(F.lit(body), n)) == bounded(body, n)


def test_evidence(spark):
    cases = [(["widget", "page"], "Widget", "src/page.py", "widget widget widget widget page", True), (["a", "a"], "ab", "x", "aaa", False), ([], "q", "p", "b", True)]
    for terms, name, path, body, production in cases:
        expected = 0.01 if production else 0.0
        for t in terms:
            expected += 3 if t == name.lower() else 2 if t in name.lower() else 0
            expected += (0.5 if t in path.lower() else 0) + min(body.lower().count(t), 3) * 0.25
        got = value(spark, text.evidence(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), F.lit(name), F.lit(path), F.lit(body), F.lit(production)))
        assert got == pytest.approx(expected)


@pytest.mark.parametrize(("reply", "expected"), [('["a", " b ", ""]', ["a", "b"]), ('```json\n["x"]\n```', ["x"]), ("no json", None), ("{}", None), ("[]", None), (None, None)])
def test_parsed_queries(spark, reply, expected):
    assert value(spark, text.parsed_queries(F.lit(reply).cast("string"))) == expected


def test_globs(spark):
    rows = spark.createDataFrame([("src/a_b.py",), ("src/aXb.py",), ("SRC/deep/x.py",), ("100%.py",)], "p string")
    match = lambda g: {r["p"] for r in rows.where(F.col("p").ilike(text.like_pattern(g))).collect()}
    assert match("src/a_b.py") == {"src/a_b.py"}
    assert match("src/**.py") == match("src/*.py") == {"src/a_b.py", "src/aXb.py", "SRC/deep/x.py"}
    assert match("100%.??") == {"100%.py"}


def test_ages(spark):
    for seconds, age in ((5.0, "5s"), (59.4, "59s"), (200.0, "3m"), (5400.0, "1.5h"), (172800.0, "2.0d")):
        assert value(spark, text.age(F.lit(seconds))) == age


def test_vectors_that_are_not_of_norm_one(spark):
    q, near, along = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.5), F.lit(1.0)), F.array(F.lit(9.0), F.lit(0.0))
    assert value(spark, vectors.l2_distance(q, near)) < value(spark, vectors.l2_distance(q, along))
    assert value(spark, vectors.cosine(q, near)) < value(spark, vectors.cosine(q, along))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.cosine(q, zero)) == 0 and value(spark, vectors.normalized(zero)) == [0, 0]
    assert value(spark, vectors.cosine(q, F.lit(None).cast("array<double>"))) == 0


def test_stems_equal_sqlite():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab('t', 'row')")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional valency digitizer radically analogously vietnamization predication operator feudalism decisiveness hopefulness formality sensibility triplicate formalize electrical goodness revival allowance inference airliner adjustable replacement dependent adoption communism effective rate cease controlling oscillators running flies".split()
    for word in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (word,))
        assert porter(word) == db.execute("select term from v").fetchone()[0]


def test_ages_are_rounded_as_printf_does(spark):
    """Every second where a half could be, and its neighbours: exact halves go to even digits, others by the double's value."""
    import duckdb

    some = [*range(0, 3700, 7), *range(30, 3600, 60), *(n * 180 + d for n in range(20, 480) for d in (-1, 0, 1)), *(n * 4320 + d for n in range(20, 40_000) for d in (-1, 0, 1))]
    rows = spark.createDataFrame([(float(s),) for s in sorted(set(some))], "s double")
    found = rows.select("s", text.age(F.col("s")).alias("age")).toPandas()
    sql = "select s, case when s < 60 then printf('%.0fs', s) when s < 3600 then printf('%.0fm', s / 60) when s < 86400 then printf('%.1fh', s / 3600) else printf('%.1fd', s / 86400) end as age from found"
    wanted = duckdb.sql(sql).fetchall()
    assert list(found.itertuples(index=False, name=None)) == wanted
