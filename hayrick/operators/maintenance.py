"""Keeping an index up to date: diffs, replacements, guards, caches, journals.

Tables are immutable; an update is an anti join and a union. Keys are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parse states that keep a file's old symbols.
STALE = ("unreadable", "unsupported", "error")


def missing(rows: DataFrame, present: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(present, key, "left_anti")


def diff(inventory: DataFrame, known: DataFrame, *, scoped: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """path and change (new, changed, same, removed). Both have path, mtime_ns, size.

    A scoped refresh looks only at the paths in `scoped`, and at all of them as changed;
    removals are global. Rows the scope leaves out are not returned.
    """
    here = inventory.select("path", F.struct("mtime_ns", "size").alias("now"))
    there = known.select("path", F.struct("mtime_ns", "size").alias("before"))
    both = here.join(there, "path", "full_outer")
    recapture = F.lit(rebuild or scoped is not None)
    change = F.when(F.col("now").isNull(), "removed").when(F.col("before").isNull(), "new").when(recapture | ~F.col("now").eqNullSafe(F.col("before")), "changed").otherwise("same")
    found = both.select("path", change.alias("change"))
    if scoped is None:
        return found
    wanted = scoped.select("path").distinct().withColumn("wanted", F.lit(True))
    return found.join(wanted, "path", "left").where((F.col("change") == "removed") | F.col("wanted")).drop("wanted")


def drift(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many files are gone, new and changed."""
    found = diff(inventory, known)
    return found.agg(*[F.count_if(F.col("change") == what).cast("bigint").alias(name) for what, name in (("removed", "gone"), ("new", "new"), ("changed", "changed"))])


def publish(symbols: DataFrame, staged: DataFrame, states: DataFrame, removed: DataFrame) -> DataFrame:
    """Symbols after a publication: those of staged files replaced, those of removed files dropped; files that couldn't be read or parsed keep theirs.

    states: path and status of every staged file.
    """
    good = states.where(~F.col("status").isin(*STALE)).select("path")
    gone = good.unionByName(removed.select("path")).distinct()
    kept = symbols.join(gone, "path", "left_anti")
    return kept.unionByName(staged.join(good, "path", "left_semi"))


def upsert(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(changes, key, "left_anti").unionByName(changes)


def attachable(staged: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Results computed outside of a publication count only where nothing they were computed from has changed."""
    return staged.join(current.select(*keys).distinct(), keys, "left_semi")


def distinct_inputs(rows: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """embed_key, one text and the number of rows that share it: what a model has to see once."""
    keyed = rows.withColumn("embed_key", F.sha2(F.col(text).cast("binary"), 256))
    return keyed.groupBy("embed_key").agg(F.min(text).alias(text), F.count(F.lit(1)).alias("n_rows"), F.min(id_column).alias("first_id"))


def cache_split(inputs: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """inputs with hit: whether the cache has a whole vector of that input. cache: input_hash, dim, vector."""
    whole = cache.where((F.col("dim") == dim) & (F.size("vector") == dim)).select(F.col("input_hash").alias("embed_key"), F.lit(True).alias("hit")).distinct()
    return inputs.join(whole, "embed_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def latest(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key: a journal's current state. Aggregated before the shuffle."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("row"))
    return last.select(key, "row.*")


def joined_job(active: DataFrame) -> DataFrame:
    """Per repository the first active job, which a new request joins. active: repo, job_id, created_at."""
    return active.groupBy("repo").agg(F.min(F.struct("created_at", "job_id")).alias("j")).select("repo", "j.job_id", "j.created_at")


def reconcile(jobs: DataFrame, current: Column) -> DataFrame:
    """Queued and running jobs other than the current one were interrupted."""
    abandoned = F.col("state").isin("queued", "running") & ~F.coalesce(F.col("job_id") == current, F.lit(False))
    return jobs.withColumn("state", F.when(abandoned, "interrupted").otherwise(F.col("state")))


def parse_coverage(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def coverage_reasons(symbols: DataFrame, vectors: DataFrame, states: DataFrame) -> DataFrame:
    """One row: counts, and the reasons for which answers are degraded."""
    figures = symbols.agg(F.count(F.lit(1)).alias("n_symbols")).crossJoin(missing(symbols, vectors, "id").agg(F.count(F.lit(1)).alias("n_missing")))  # one row each
    issues = states.agg(F.count_if(F.col("status").isin("partial", "error", "unsupported", "unreadable")).alias("n_issues"))
    reasons = F.array_compact(F.array(F.when(F.col("n_missing") > 0, "DENSE_INDEX_PARTIAL"), F.when(F.col("n_issues") > 0, "PARSE_COVERAGE_PARTIAL")))
    return figures.crossJoin(issues).withColumn("reasons", F.array_join(reasons, ","))


def sessions(changes: DataFrame, gap_seconds: int, by: list[str], when: str = "ts") -> DataFrame:
    """Runs of changes without a gap of gap_seconds or more: by, session start, end and changes."""
    w = Window.partitionBy(*by).orderBy(when)
    fresh = F.coalesce((F.col(when).cast("double") - F.lag(F.col(when).cast("double")).over(w)) >= gap_seconds, F.lit(True))
    marked = changes.withColumn("session", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "session").agg(F.min(when).alias("start"), F.max(when).alias("end"), F.count(F.lit(1)).alias("n"))


def backoff(failures: Column, interval: float = 2.0, most: float = 300.0) -> Column:
    return F.least(F.lit(interval) * F.pow(F.lit(2.0), failures), F.lit(most))
