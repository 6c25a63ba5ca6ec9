"""Evaluation of a search over golden cases, and replays of saved pools."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.errors import HayrickError
from hayrick.functions import renaming, text
from hayrick.operators import evaluate, fusion
from hayrick.plans import search
from hayrick.plans.index import coverage
from hayrick.sources import inventory, scratch
from hayrick.sources.store import Store


def gold_ids(cases: DataFrame, symbols: DataFrame) -> DataFrame:
    """Cases with gold_id, the smallest id of their symbol; a case whose symbol the index lacks is an error."""
    ids = symbols.groupBy("path", "qualname").agg(F.min("id").alias("gold_id"))
    found = cases.join(ids, (F.col("gold_path") == F.col("path")) & (F.col("gold_qualname") == F.col("qualname")), "left").drop("path", "qualname")
    lost = [r["id"] for r in found.where(F.col("gold_id").isNull()).select("id").limit(20).collect()]
    if lost:
        raise HayrickError("INVALID_ARGUMENT", f"cases without their symbol in the index: {', '.join(map(str, lost))}")
    return found


def run_suite(spark: SparkSession, store: Store, cases: DataFrame, k: int = 10, *, mode: str = "balanced", intent: str = "implementation", limit: int = 50, expand=None, embed=None, cache=None, rerank=None) -> dict:
    """All cases of a suite as one batch, each ranked over its full pool: ranks, losses, channels, coverage and summary figures.

    A case's latency is its share of the batch's time.
    """
    began, epoch = time.monotonic(), store.epoch()
    golden = gold_ids(cases, store.read(spark, "symbols", epoch))
    asked = golden.select("id", "query").collect()  # a suite is a few dozen cases
    if mode == "fast":
        expand = embed = rerank = None
    elif mode == "balanced":
        expand = None
    models = spark.createDataFrame([(r["id"], r["query"], expand(r["query"]) if expand else []) for r in asked], "qid string, query string, model array<string>")
    queries = models.select("qid", F.posexplode(text.query_list(F.col("query"), F.col("model"))).alias("list_no", "query"))
    targets, warnings = None, []
    if embed:
        wanted = [tuple(r) for r in (queries if expand else queries.where("list_no = 0")).orderBy("qid", "list_no").collect()]
        found, warning = cache.of_queries(spark, [q for *_, q in wanted], embed) if cache else embed([q for *_, q in wanted], True)
        warnings += [warning] if warning else []
        targets = [(qid, n, v) for (qid, n, _), v in zip(wanted, found, strict=True)] if found is not None else None
    found = search.trace(spark, store, epoch, queries, targets, limit=limit, intent=intent)
    pool = scratch.written(found.pool, "pool")
    order = search.by_evidence(pool, queries)
    if rerank:
        replies, valid = asked_reranker(pool.join(F.broadcast(models.select("qid", "query")), "qid"), rerank)
        order = fusion.apply_rerank(order.drop("new_rank"), replies, valid, F.col("score"))
    if intent == "implementation":
        order = fusion.prefer_production(order.drop("rank").withColumnRenamed("new_rank", "rank"))
    results = scratch.written(order.select("qid", F.col("new_rank").alias("rank"), "id", "path"), "results")
    gold = golden.select(F.col("id").alias("qid"), "gold_id", "gold_path")
    latency = (time.monotonic() - began) / max(1, len(asked))
    ranks = evaluate.case_ranks(results, gold).withColumns({"latency": F.lit(latency), "warnings": F.lit(warnings).cast("array<string>")})
    # Where the gold symbol was seen: in a ranking, in the fused list, among the siblings
    mine = lambda rows, *flags: gold.join(rows.withColumnRenamed("id", "gold_id"), ["qid", "gold_id"]).groupBy("qid").agg(*[F.max(f).alias(n) for n, f in flags])
    listed = mine(found.rankings, ("fts", F.col("list_no") < search.DENSE), ("dense", F.col("list_no") >= search.DENSE))
    pooled = mine(pool, ("in_pool", F.lit(True)))
    widened = mine(found.expansion, ("expansion", F.lit(True)))
    seen = ranks.join(listed, "qid", "left").join(pooled, "qid", "left").join(widened, "qid", "left").na.fill(False, ["fts", "dense", "in_pool", "expansion"])
    facts = seen.select("qid", "rank", evaluate.loss_stage(F.col("rank"), F.col("in_pool"), F.col("fts") | F.col("dense"), k).alias("stage"), evaluate.retrieved_by(F.col("fts"), F.col("dense"), F.col("expansion")).alias("channels"))
    by_case = {r["qid"]: {"rank": r["rank"], "loss_stage": r["stage"], "retrieved_by": list(r["channels"])} for r in facts.collect()}
    losses = [c["loss_stage"] for c in by_case.values() if c["loss_stage"]]
    return {"k": k, **evaluate.summary(ranks, k).first().asDict(), "loss_stages": {s: losses.count(s) for s in sorted(set(losses))}, "cases": by_case, "coverage": coverage(spark, store), "warnings": warnings}


def asked_reranker(pools: DataFrame, rerank: Callable, form: str = "body") -> tuple[DataFrame, DataFrame]:
    """A reranker's replies to pools (qid, query, rank and the symbol), one query a group, and which of them are valid."""
    shown = pools.select("qid", "query", "rank", DOCUMENTS[form]().alias("document"))

    def ask(rows):
        import pandas as pd

        rows = rows.sort_values("rank")
        reply, _ = rerank(rows["query"].iloc[0], list(rows["document"]))
        good = search.valid_reply(reply, len(rows))
        pairs = reply if good else []
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]] * len(pairs), "idx": [int(i) for i, _ in pairs], "score": [float(s) for _, s in pairs], "response_pos": list(range(len(pairs)))})

    replies = scratch.written(shown.groupBy("qid").applyInPandas(ask, "qid string, idx int, score double, response_pos int"), "replies")
    return replies, fusion.valid_orders(replies, pools.groupBy("qid").agg(F.count(F.lit(1)).alias("size")))


DOCUMENTS: dict[str, Callable[[], F.Column]] = {
    "signature": lambda: F.concat_ws("\n", "signature", "docstring"),
    "locator": lambda: F.concat_ws("\n", F.concat(F.col("path"), F.lit(" :: "), F.col("qualname"), F.lit(" ("), F.col("kind"), F.lit(")")), "full_signature", "docstring"),
    "body": lambda: text.rerank_document(*map(F.col, ("path", "qualname", "kind", "full_signature", "docstring", "body"))),
}


def replay(pools: DataFrame, rerank: Callable, form: str = "body", score: F.Column | None = None) -> DataFrame:
    """Saved pools ordered anew: qid, rank (old), new_rank, valid. Pools are reranked in parallel, one query a group."""
    replies, valid = asked_reranker(pools, rerank, form)
    pool = pools.select("qid", "rank", "path", "qualname", "score")
    return fusion.apply_rerank(pool, replies, valid, F.col("score") if score is None else score).select("qid", "path", "qualname", "rank", "new_rank", "valid")


def attach_bodies(pools: DataFrame, parsed: DataFrame) -> DataFrame:
    """Bodies and ends from a snapshot parsed anew, by path, qualified name and line; of spans that repeat, the first.

    A candidate that the snapshot lacks means it is another one: that is an error, and so is
    a path that leaves the snapshot.
    """
    outside = pools.where(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")).select("path").limit(1).collect()
    if outside:
        raise HayrickError("INVALID_ARGUMENT", f"a path outside of the snapshot: {outside[0]['path']}")
    keys = ["path", "qualname", "line"]
    spans = parsed.where(F.col("qualname").isNotNull()).groupBy(*keys).agg(F.min(F.struct("end_line", "body")).alias("s"))
    found = pools.drop("body", "end_line").join(spans, keys, "left")
    lost = [r["qualname"] for r in found.where(F.col("s").isNull()).select("qualname").limit(5).collect()]
    if lost:
        raise HayrickError("INVALID_ARGUMENT", f"the snapshot lacks {', '.join(map(str, lost))}")
    return found.select("*", "s.end_line", "s.body").drop("s")


def check_snapshot(root: str, revision: str) -> None:
    """The worktree must be clean and at the suite's revision."""
    commit, dirty = inventory.head(root)
    if commit != revision or dirty:
        raise HayrickError("INVALID_ARGUMENT", "the worktree is not a clean checkout of the suite's revision", expected=revision, found=commit)


def save(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def obfuscate(value: object, terms: dict[str, str], drop: tuple[str, ...] = ("issue_url",)) -> object:
    """Private words replaced in keys and strings of a JSON value."""
    rename = renaming.renamer(terms)

    def walk(v: object) -> object:
        if isinstance(v, str):
            return rename(v)
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {rename(k): walk(x) for k, x in v.items() if k not in drop}
        return v

    return walk(value)


def obfuscated_suite(suite: dict, terms: dict[str, str]) -> dict:
    """A suite fit for publication: names and revision replaced. An error if the revision stays readable or two cases get one locator."""
    after = obfuscate(suite, terms)
    if suite["revision"] in json.dumps(after):
        raise HayrickError("INVALID_ARGUMENT", "the terms don't replace the suite's revision")
    places = lambda s: {(c["expected"]["path"], c["expected"]["qualname"]) for c in s["cases"]}
    if len(places(after)) != len(places(suite)):
        raise HayrickError("INVALID_ARGUMENT", "two locators are the same once their names are replaced")
    return after
