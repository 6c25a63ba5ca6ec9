"""Hybrid search over an index.

Each query goes through exact lookup (not in deep mode), or else through lexical rankings
of itself and its variants and a dense ranking, which are fused, joined with their symbols
and widened by siblings of their files. A reranker's reply, where it is valid, orders the
pool; otherwise its evidence does. Production code is preferred when the intent is
implementation. trace() plans all stages of a batch of queries at once; search() is one query
of it with models, deadline and report. Models are injected callables, and only a pool that a
reranker has to see comes to the driver.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrick.deadlines import Deadline, Late
from hayrick.errors import HayrickError, check_limit, check_search
from hayrick.functions import text, vectors
from hayrick.functions.porter import stem
from hayrick.operators import dense, fusion, lexical, maintenance
from hayrick.sources.store import Store
from hayrick.sources.vector_cache import VectorCache

Expand = Callable[[str], list[str]]
Embed = Callable[[list[str], bool], tuple[list[list[float]] | None, str | None]]
Rerank = Callable[[str, list[str]], tuple[list[tuple[int, float]] | None, str | None]]
WIRE = ("id", "path", "name", "qualname", "kind", "lang", "line", "end_line", "signature", "full_signature", "docstring", "source_role", "score")


@dataclass
class Report:
    results: list[dict]
    stages: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    epoch: int = 0  # the publication that was searched

    def degrade(self, reason: str, warning: str | None = None) -> None:
        if reason not in self.reasons:
            self.reasons.append(reason)
        if warning:
            self.warnings.append(warning)


def exact(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols of that very name, ten at most, shortest qualified names first."""
    found = symbols.where((F.col("qualname") == query) | (F.col("name") == query))
    return found.orderBy(F.length("qualname"), "path", "line", "id").limit(10)


def is_identifier(query: str) -> bool:
    return len(query) <= 200 and re.fullmatch(r"[\w.]+", query) is not None


def phrases_of(query: Column) -> Column:
    """Terms of a query, each as the words it is indexed by: foo_bar is the phrase of foo and bar."""
    return F.filter(F.transform(text.match_terms(query), lambda t: text.index_tokens(t)), lambda words: F.size(words) > 0)


def lexical_lists(postings: DataFrame, lengths: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Rankings of queries (qid, list_no, query) by BM25 over the stored stemmed terms and phrases of them: qid, list_no, rank, id."""
    terms = queries.select(F.struct("qid", "list_no").alias("qid"), F.explode(phrases_of(F.col("query"))).alias("words"))
    terms = terms.select("qid", stem(F.col("words")).alias("words")).withColumn("term", F.array_join("words", " "))
    asked = [(r["term"], r["words"]) for r in terms.select("term", "words").distinct().collect()]  # of one call's queries
    # The words reach the scan, whose files are sorted by them.
    found = postings.where(F.col("term").isin(sorted({w for _, words in asked for w in words})))
    if any(len(words) > 1 for _, words in asked):
        found = lexical.asked_frequencies(found, postings.sparkSession.createDataFrame(asked, "term string, words array<string>"))
    best = lexical.top_k(lexical.bm25(terms.select("qid", "term"), found.select("term", "id", "tf"), lengths), limit)
    return best.select("qid.qid", "qid.list_no", "rank", "id")


@dataclass
class Trace:
    """What every stage of a batch of queries gave, by qid."""

    rankings: DataFrame  # qid, list_no (from DENSE on: dense ones), rank, id
    fused: DataFrame  # qid, rank, score and the symbol
    expansion: DataFrame  # qid, id, position
    pool: DataFrame  # qid, rank, score and the symbol: fused, then expansion


DENSE = 1000


def trace(spark: SparkSession, store: Store, epoch: int, queries: DataFrame, targets: list[tuple] | None = None, *, limit: int = 50, intent: str = "any", expansion: bool = True) -> Trace:
    """One plan for a batch; without expansion, pools are the fused candidates alone. queries: qid, list_no (0: as asked), query. targets: (qid, list_no, vector) of those that have one."""
    symbols = store.read(spark, "symbols", epoch)
    rankings = lexical_lists(store.read(spark, "postings", epoch), store.read(spark, "lengths", epoch), queries, limit)
    vectors_ = store.read(spark, "vectors", epoch)
    kind = queries.schema["qid"].dataType
    if targets:
        asked = spark.createDataFrame([(n, [float(x) for x in v]) for n, (*_, v) in enumerate(targets)], "qid bigint, embedding array<double>")
        names = spark.createDataFrame([(n, q, DENSE + k) for n, (q, k, _) in enumerate(targets)], f"n bigint, qid {kind.simpleString()}, list_no int")
        near = dense.knn(asked, vectors_, limit, id_column="symbol_id").withColumnRenamed("qid", "n")
        rankings = rankings.unionByName(near.join(F.broadcast(names), "n").select("qid", "list_no", "rank", "id"))
    fused = fusion.fuse(rankings, limit).join(symbols, "id")
    # Files of a query's candidates come first; hits and cosine are worked out for their symbols only.
    words = queries.where("list_no = 0").select("qid", text.distinct_terms(F.col("query")).alias("terms"))
    files = fusion.best_files(fused.select("qid", "id", "path", "score", "rank")).select("qid", "path")
    siblings = symbols.select("id", "path", "body").join(files, "path").join(F.broadcast(words), "qid")
    siblings = siblings.select("qid", "id", "path", text.term_hits(F.col("body"), F.col("terms")).alias("hits"))
    if targets:
        first = spark.createDataFrame([(q, [float(x) for x in v]) for q, k, v in targets if k == 0], f"qid {kind.simpleString()}, target array<double>")
        siblings = siblings.join(vectors_.select(F.col("symbol_id").alias("id"), "embedding"), "id", "left").join(F.broadcast(first), "qid", "left")
        siblings = siblings.withColumn("cosine", F.coalesce(vectors.cosine(F.col("embedding"), F.col("target")), F.lit(0.0))).drop("embedding", "target")
    else:
        siblings = siblings.withColumn("cosine", F.lit(0.0))
    more = fusion.expand_pool(fused.select("qid", "id", "path", "score", "rank"), siblings).select("qid", "id", "position")
    columns = ["qid", *symbols.columns, "score", "rank"]
    widened = more.join(symbols, "id").select("*", F.lit(0.0).alias("score"), (F.lit(limit) + F.col("position")).alias("rank"))
    pool = fused.select(columns).unionByName(widened.select(columns)) if expansion else fused.select(columns)
    if intent == "tests":
        pool = pool.where(F.col("source_role").isin("test", "fixture"))
    pool = pool.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return Trace(rankings, fused, more, pool)


def by_evidence(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """The pool with new_rank and score by the evidence of each query's terms."""
    raw = queries.where("list_no = 0").select("qid", F.transform(text.match_terms(F.col("query")), lambda t: F.lower(t)).alias("terms"))
    found = text.evidence(F.col("terms"), *map(F.col, ("qualname", "path", "body")), F.col("source_role") == "production")
    scored = pool.join(F.broadcast(raw), "qid").withColumn("evidence", found).drop("terms")
    return fusion.reorder(scored, F.col("evidence")).withColumn("score", F.col("evidence")).drop("evidence")


def search(
    spark: SparkSession,
    store: Store,
    query: str,
    k: int = 10,
    *,
    mode: str = "balanced",
    intent: str = "implementation",
    limit: int = 50,
    expand: Expand | None = None,
    embed: Embed | None = None,
    rerank: Rerank | None = None,
    cache: VectorCache | None = None,
    deadline: float | None = None,
    expansion: bool = True,
) -> Report:
    """One query. After `deadline` seconds what there is by then is the answer: no Spark job goes on, and no model is waited for."""
    check_search(k, mode, intent)
    began, report, until = time.monotonic(), Report([]), Deadline(spark, deadline)
    report.epoch = epoch = store.epoch()
    if not epoch:
        raise HayrickError("INDEX_NOT_READY", "nothing has been published")
    if mode == "fast":
        expand = embed = rerank = None
    elif mode == "balanced":
        expand = None
    try:
        _search(spark, store, query, k, report, until, mode=mode, intent=intent, limit=limit, expand=expand, embed=embed, rerank=rerank, cache=cache, expansion=expansion)
    except Late:
        report.degrade("DEADLINE_FALLBACK", None if report.results else "the time was up before there were candidates")
        if rerank and "rerank" not in report.stages:
            report.degrade("RERANK_FALLBACK")
    report.seconds["total"] = time.monotonic() - began
    return report


def _search(spark: SparkSession, store: Store, query: str, k: int, report: Report, until: Deadline, *, mode, intent, limit, expand, embed, rerank, cache, expansion) -> None:
    """Fill in the report; what is in it when the time is up stays."""
    epoch, bare = report.epoch, query.strip()
    symbols = store.read(spark, "symbols", epoch)
    if mode != "deep" and is_identifier(bare):
        hits = exact(symbols, bare)
        if intent == "tests":
            hits = hits.where(F.col("source_role").isin("test", "fixture"))
        numbered = hits.select("*", F.lit(0).alias("qid"), F.lit(1.0).alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.length("qualname"), "path", "line", "id")))  # ten rows at most
        rows = fusion.prefer_production(numbered) if intent == "implementation" else numbered.withColumn("new_rank", F.col("rank"))
        with until.jobs():
            found = rows.orderBy("new_rank").limit(k).select(*WIRE).collect()
        if found:
            report.results, report.stages = [r.asDict() for r in found], ["exact"]
            return
    report.stages.append("lexical")
    first = spark.createDataFrame([(0, query)], "qid int, query string")
    model = F.array(*map(F.lit, until.call(expand, query))) if expand else None
    queries = first.select("qid", F.posexplode(text.query_list(F.col("query"), model)).alias("list_no", "query"))
    targets = None
    if embed:
        with until.jobs():
            wanted = [r["query"] for r in queries.orderBy("list_no").collect()] if expand else [query]
        try:
            # The cache's own jobs run in the thread of the call.
            found, warning = until.call(cache.of_queries, spark, wanted, embed) if cache else until.call(embed, wanted, True)
        except Late:
            report.degrade("DEADLINE_FALLBACK")
            raise
        if found is None:
            report.degrade("QUERY_MODEL_UNAVAILABLE", warning)
        else:
            report.stages.append("dense")
            targets = [(0, n, v) for n, v in enumerate(found)]
        known = store.read(spark, "vectors", epoch)
        with until.jobs():
            if not maintenance.missing(symbols.select("id"), known.select(F.col("symbol_id").alias("id")), "id").isEmpty():
                report.degrade("DENSE_INDEX_PARTIAL")
    issues = store.read(spark, "parse_state", epoch).where(F.col("status").isin("partial", "error", "unsupported", "unreadable"))
    with until.jobs():
        pool = trace(spark, store, epoch, queries, targets, limit=limit, intent=intent, expansion=expansion).pool
        if not issues.isEmpty():
            report.degrade("PARSE_COVERAGE_PARTIAL")

    def answer(order: DataFrame) -> list[dict]:
        if intent == "implementation":
            order = fusion.prefer_production(order.drop("rank").withColumnRenamed("new_rank", "rank"))
        with until.jobs():
            return [r.asDict() for r in order.orderBy("new_rank").limit(k).select(*WIRE).collect()]

    if rerank and until.end is None:
        shown, reply, warning = _reranked(pool, query, rerank, until)
    elif rerank:  # the answer without a reranker is there before it is asked
        report.results = answer(by_evidence(pool, queries))
        shown, reply, warning = _reranked(pool, query, rerank, until)
    else:
        report.results = answer(by_evidence(pool, queries))
        return
    replies = [(0, i, float(s), n) for n, (i, s) in enumerate(reply)] if valid_reply(reply, shown) else []
    if replies:
        scores = spark.createDataFrame(replies, "qid int, idx int, score double, response_pos int")
        ok = spark.createDataFrame([(0, True)], "qid int, valid boolean")
        report.results = answer(fusion.apply_rerank(pool, scores, ok, F.col("score")).withColumn("score", F.col("final")))
        report.stages.append("rerank")
        if warning:
            report.warnings.append(warning)
    else:
        report.degrade("RERANK_FALLBACK", warning or "the reranker gave no usable order; candidates are in the order of their evidence")
        report.results = report.results or answer(by_evidence(pool, queries))


def _reranked(pool: DataFrame, query: str, rerank: Rerank, until: Deadline) -> tuple[int, object, str | None]:
    """How many documents the reranker saw, its reply and its warning."""
    with until.jobs():
        documents = [r["document"] for r in pool.orderBy("rank").select(text.rerank_document(*map(F.col, ("path", "qualname", "kind", "full_signature", "docstring", "body"))).alias("document")).collect()]  # limit + 50 rows at most
    return len(documents), *until.call(rerank, query, documents)


def valid_reply(reply: object, n: int) -> bool:
    """A list that names each of n candidates once, with finite numbers; True and False are no numbers."""
    if not isinstance(reply, list) or len(reply) != n:
        return False
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")
    seen = set()
    for item in reply:
        if not (isinstance(item, (tuple, list)) and len(item) == 2 and isinstance(item[0], int) and number(item[0]) and number(item[1]) and 0 <= item[0] < n):
            return False
        seen.add(item[0])
    return len(seen) == n


def map_symbols(spark: SparkSession, store: Store, glob: str = "**", limit: int = 100, offset: int = 0) -> dict:
    """A page of symbols under a glob, in the order of path and line, and where the next page begins (None at the end)."""
    check_limit(limit)
    rows = store.read(spark, "symbols").where(F.col("path").ilike(text.like_pattern(glob)))
    page = rows.orderBy("path", "line", "id").offset(offset).limit(limit + 1).select("id", "path", "qualname", "kind", "line", "signature", "source_role").collect()
    return {"symbols": [r.asDict() for r in page[:limit]], "next": offset + limit if len(page) > limit else None}
