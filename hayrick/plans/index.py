"""Building and refreshing an index of a worktree."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrick.functions import roles, text
from hayrick.functions.porter import stem
from hayrick.operators import lexical, maintenance
from hayrick.sources import inventory, scratch, symbols
from hayrick.sources.store import TABLES, Store
from hayrick.sources.vector_cache import DOCUMENT, VectorCache

#: Embeds a batch: (texts, is_query) -> vectors, or None with a warning.
Embed = Callable[[list[str], bool], tuple[list[list[float]] | None, str | None]]


def symbol_rows(parsed: DataFrame, repo: str, first_id: int) -> DataFrame:
    """Parsed symbols with their texts, keys and ids in the order of path and position."""
    found = parsed.where(F.col("qualname").isNotNull())
    # Ids: files are dealt by ranges of paths, counted up within each, and begin where the ranges before end.
    at = found.groupBy("path").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("path")
    at = scratch.written(at.withColumn("part", F.spark_partition_id()), "files-in-order")
    sums, total = [], 0
    for r in at.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        sums.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(found.sparkSession.createDataFrame(sums, "part int, offset bigint"))
    earlier = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = at.withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(offsets, "part").withColumn("before", F.col("offset") + F.col("inner"))
    inside = F.row_number().over(Window.partitionBy("path").orderBy("line", "end_line", "qualname"))
    numbered = found.withColumn("k", inside).join(before.select("path", "before"), "path")
    out = numbered.select(
        (F.lit(first_id) + F.col("before") + F.col("k")).alias("id"),
        F.lit(repo).alias("repo"),
        *("path", "name", "qualname", "kind", "lang", "line", "end_line", "signature", "full_signature", "docstring", "body"),
        text.search_text(*map(F.col, ("qualname", "path", "signature", "docstring", "body"))).alias("search_text"),
        text.embed_text(*map(F.col, ("kind", "qualname", "path", "signature", "docstring", "body"))).alias("embed_text"),
        roles.source_role(F.col("path")).alias("source_role"),
    )
    return out.withColumn("embed_key", F.sha2(F.col("embed_text").cast("binary"), 256))


def terms_of(symbols_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with positions, and lengths, of symbols by stemmed terms."""
    docs = symbols_.select(F.col("id").alias("doc_id"), stem(text.index_tokens(F.col("search_text"))).alias("tokens"))
    return lexical.postings(docs, tokens=F.col("tokens")), lexical.lengths(docs, tokens=F.col("tokens"))


def refresh(spark: SparkSession, store: Store, root: str, *, rebuild: bool = False, paths: list[str] | None = None, cancelled: Callable[[], bool] = lambda: False, job_id: str | None = None) -> dict:
    """Parse what has changed and publish it as one epoch; returns counters.

    Files that can't be read or parsed keep their symbols and their old state, so they are
    tried again; removed files go, whatever the scope. Only symbols of files that changed
    are tokenised; other symbols keep their postings.
    """
    with store.writing():
        here = inventory.inventory(spark, root)
        known = store.read(spark, "files")
        scope = inventory.scoped(here, root, paths) if paths is not None else None
        changes = scratch.written(maintenance.diff(here, known, scoped=scope, rebuild=rebuild), "changes")
        # What was read is written out: results used several times are the same each time.
        staged = inventory.capture(changes.where(F.col("change").isin("new", "changed")), root).join(here.select("path", "mtime_ns"), "path")
        staged = scratch.written(staged, "staged")
        removed = changes.where("change = 'removed'").select("path")
        parsed = scratch.written(symbols.parse(staged), "parsed")
        states = parsed.where(F.col("qualname").isNull()).select("path", "status", "detail")
        counts = {r["status"]: r["n"] for r in maintenance.parse_coverage(states).collect()}
        n_removed = removed.count()
        if cancelled():
            return {"state": "cancelled", "epoch": store.epoch()}
        current = store.read(spark, "symbols")
        fresh = scratch.written(symbol_rows(parsed, root, int((store.current() or {}).get("top", 0))).select(current.columns), "fresh")
        good = states.where(~F.col("status").isin(*maintenance.STALE)).select("path")
        fresh = fresh.join(good, "path", "left_semi")
        top = fresh.agg(F.max("id")).first()[0] or (store.current() or {}).get("top", 0)
        # Only what changes is written: new rows, and keys of rows that are over.
        gone = good.unionByName(removed).distinct()
        ids = scratch.written(current.select("id", "path").join(gone, "path", "left_semi").select("id"), "over")
        files = staged.join(good, "path", "left_semi").select(F.lit(root).alias("repo"), "path", "mtime_ns", "size", "hash")
        tried = states.select(F.lit(root).alias("repo"), "path", "status", "detail", F.lit(time.time()).alias("attempted_at"))
        made = dict(zip(("postings", "lengths"), terms_of(fresh), strict=True))
        rows = {"symbols": fresh, "files": files, "parse_state": tried, **made}
        over = {"symbols": ids, "postings": ids, "lengths": ids, "vectors": ids.withColumnRenamed("id", "symbol_id"), "files": gone, "parse_state": states.select("path").unionByName(removed)}
        if cancelled():
            return {"state": "cancelled", "epoch": store.epoch()}
        commit, dirty = inventory.head(root)
        epoch = store.publish(spark, rows, over, head=commit, dirty=dirty, indexed_at=time.time(), job_id=job_id, top=int(top))
    return {"state": "completed", "epoch": epoch, "files": sum(counts.values()), "removed": n_removed, "statuses": counts}


def embed(spark: SparkSession, store: Store, cache: VectorCache, model: Embed) -> dict:
    """Vectors for symbols that lack one: known ones from the cache, the others by the model, which the cache then keeps."""
    known = cache.read(spark, DOCUMENT)
    made = scratch.written(embed_missing(store, spark, model, known=known), "made")
    if not made.isEmpty():
        cache.store(made, DOCUMENT)
    return attach_vectors(spark, store, cache.read(spark, DOCUMENT), cache.dim)


def attach_vectors(spark: SparkSession, store: Store, cache: DataFrame, dim: int) -> dict:
    """Publish vectors of symbols whose input the cache knows: computed outside, attached only where nothing has changed since.

    cache: input_hash, dim, vector. Inputs that it lacks are counted as missing.
    """
    with store.writing():
        now = store.read(spark, "symbols")
        lacking = maintenance.missing(now, store.read(spark, "vectors").select(F.col("symbol_id").alias("id")), "id")
        good = cache.where((F.col("dim") == dim) & (F.size("vector") == dim)).groupBy("input_hash").agg(F.max("vector").alias("embedding"))
        ready = lacking.join(good, F.col("embed_key") == F.col("input_hash")).select("repo", F.col("id").alias("symbol_id"), "embedding", "embed_key")
        current = now.select(F.col("id").alias("symbol_id"), "embed_key")
        fresh = maintenance.attachable(ready, current, ["symbol_id", "embed_key"]).drop("embed_key")
        fresh = scratch.written(fresh, "attached")
        n, total = fresh.count(), lacking.count()
        if n:
            pointer = {k: v for k, v in store.pointer().items() if k not in ("version", "profile", "epoch", "published_at")}
            store.publish(spark, {"vectors": fresh}, **pointer)
    return {"attached": n, "missing": total - n, "epoch": store.epoch()}


def embed_missing(store: Store, spark: SparkSession, embed: Embed, *, known: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """Vectors of distinct inputs without one, by a model called in tasks: input_hash, dim, vector. Failed batches give no rows."""
    lacking = maintenance.missing(store.read(spark, "symbols"), store.read(spark, "vectors").select(F.col("symbol_id").alias("id")), "id")
    inputs = lacking.groupBy("embed_key").agg(F.min("embed_text").alias("embed_text"))
    if known is not None:
        inputs = inputs.join(known, F.col("embed_key") == F.col("input_hash"), "left_anti")

    def run(batches):
        import pandas as pd

        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                found, _ = embed(list(some["embed_text"]), False)
                if found is not None:
                    yield pd.DataFrame({"input_hash": some["embed_key"].values, "dim": [len(v) for v in found], "vector": found})

    return inputs.mapInPandas(run, "input_hash string, dim int, vector array<float>")


def coverage(spark: SparkSession, store: Store) -> dict:
    """How much of the index is parsed and has vectors, and the reasons for which answers are degraded."""
    states = store.read(spark, "parse_state")
    vectors = store.read(spark, "vectors").select(F.col("symbol_id").alias("id"))
    row = maintenance.coverage_reasons(store.read(spark, "symbols").select("id"), vectors, states).first()
    parsed = {r["status"]: r["n"] for r in maintenance.parse_coverage(states).collect()}
    return {"symbols": row["n_symbols"], "without_vector": row["n_missing"], "parse_coverage": parsed, "reasons": [r for r in row["reasons"].split(",") if r]}


def status(spark: SparkSession, store: Store, root: str, jobs: list[dict] | None = None) -> dict:
    """Counts, coverage, active jobs, drift of the worktree against the index, and what follows."""
    epoch = store.epoch()
    active = [j for j in jobs or [] if j["state"] in ("queued", "running")]
    if not epoch:
        return {"freshness": "building" if active else "absent", "epoch": 0, "jobs": active}
    pointer = store.pointer()
    counts = {t: store.read(spark, t).count() for t in ("symbols", "files", "vectors")}
    moved = maintenance.drift(inventory.inventory(spark, root), store.read(spark, "files")).first().asDict()
    freshness = "refreshing" if active else "stale" if any(moved.values()) else "fresh"
    return {"freshness": freshness, "epoch": epoch, "head": pointer.get("head"), "indexed_at": pointer.get("indexed_at"), **counts, **{k: v for k, v in coverage(spark, store).items() if k != "symbols"}, "drift": moved, "jobs": active, "tables": sorted(TABLES)}
