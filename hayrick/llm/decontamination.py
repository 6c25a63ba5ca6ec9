"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

An item is in a document if some `window` neighbouring aligned positions (the whole item,
if it is shorter) agree in at least `share` of them: substituted words are tolerated.

A seed is the hash of the words at the positions of a fixed mask; the mask's other positions
are ignored, so a word replaced there does no harm. Seeds at every position of every item
are joined with those of every document. A hit gives an item and a diagonal (where in the
document the item would begin). The masks are chosen so that no accepted window lacks a
seed: `least` counts, over all ways to replace as many words as a window may differ in, the
seeds that are left at least (tests go through all of them), and diagonals with fewer hits
are left out. Along the others words are compared position by position, in groups of at most
GROUP hits a row.

Words are runs of letters and digits in lower case. Items without words are never looked
for; items of one to three words are found as they are. Items of equal words are joined as
one and reported as the smallest item_id.

The seeds of the benchmark are broadcast if there are at most `broadcast_rows`, and
shuffled otherwise; so are the hits, if they carry at most as many words of items, and the
documents found.

Defined cases: null and empty texts contain nothing; very long texts are seeded whole;
repeated documents are reported each, those that share an id each by its own text; an empty
benchmark leaves all documents clean; an empty table of documents gives no rows; null item
ids are left out; other columns of the input are kept, but for those named as the results,
which are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common

#: Families of masks: for windows of 6 words and more, for 4, 5 and 8 words, and for up to 3 words, which may not differ.
LONG, SHORT, WHOLE = ((0, 1, 2, 4), (0, 3, 4, 5)), ((0, 1), (0, 2)), {n: (tuple(range(n)),) for n in (1, 2, 3)}
FAMILIES = [LONG, SHORT, *WHOLE.values()]
WINDOW, SHARE, GROUP = 20, 0.75, 64


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def item_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: w != "")


def replaced(n: int, share: float) -> int:
    """Words in which an accepted window of n words may differ."""
    return n - next(m for m in range(n + 1) if m / n >= share)


@lru_cache
def least(n: int, masks: tuple[tuple[int, ...], ...], share: float) -> int:
    """Seeds that an accepted window of n words has at least, whichever words are replaced."""
    ways = list(combinations(range(n), replaced(n, share)))
    gone = np.zeros((len(ways), n), bool)
    if ways[0]:
        gone[np.arange(len(ways))[:, None], ways] = True
    places = [[start + k for k in mask] for mask in masks for start in range(n - mask[-1])]
    return int(sum((~gone[:, p].any(1)).astype(int) for p in places).min()) if places else 0


def plan(n: int, window: int = WINDOW, share: float = SHARE) -> tuple[int, int]:
    """For items of n words the number of their family of masks, and the seeds of a diagonal that any accepted window keeps."""
    n = min(n, window)
    for k, masks in enumerate(FAMILIES):
        if found := least(n, masks, share):
            return k, found
    raise ValueError("no family of masks serves such a share")


def _seeds(rows: DataFrame, keep: list[str], families: list[int]) -> DataFrame:
    """keep, position and seed of every position, for the masks of each family."""
    masks = [(k, j, mask) for k in families for j, mask in enumerate(FAMILIES[k])]
    reach = max(mask[-1] for *_, mask in masks)
    shifted = [(F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) if k else F.col("words")).alias(f"w{k}") for k in range(reach + 1)]
    each = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("position", "z"))
    # A mask that reaches past the end has no words there: there is no seed.
    seeds = [F.when(F.col(f"z.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(10 * k + j), *[F.col(f"z.w{p}") for p in mask])) for k, j, mask in masks]
    if len(seeds) == 1:
        return each.select(*keep, "position", seeds[0].alias("seed")).where(F.col("seed").isNotNull())
    return each.select(*keep, "position", F.explode(F.array(*seeds)).alias("seed")).where(F.col("seed").isNotNull())


def agreement(doc_words: Column, hit: Column, window: int) -> Column:
    """The largest share of agreeing positions that a window along the hit's diagonal has."""
    first = F.greatest(hit["diagonal"], F.lit(0))
    skip = first - hit["diagonal"]  # words of the item before the document begins
    n = F.size(hit["item_words"])
    aligned = F.zip_with(F.slice(doc_words, first + 1, F.greatest(n - skip, F.lit(0))), F.slice(hit["item_words"], skip + 1, n), lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.lit(window), n)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    last = F.greatest(F.size(aligned) - width, F.lit(0))
    return F.array_max(F.transform(F.sequence(F.lit(0), last), lambda i: total(F.slice(aligned, i + 1, width)))) / width


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: float = SHARE, broadcast_rows: int = 1_000_000, into: tuple[str, str] = ("items", "overlap")) -> DataFrame:
    """docs with `items` (array of found item ids, ascending) and `overlap` (the largest share of agreeing positions, 0 if no diagonal was compared)."""
    docs = docs.drop(*into)
    plans = [plan(n, window, share) for n in range(1, window + 1)]
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), item_words(common.whole_text()).alias("words"))
    items = items.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))
    of_size = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in plans]), F.least(F.size("words"), F.lit(window)))
    items = common.materialize(items.select("item_id", "words", of_size(0).alias("family"), of_size(1).alias("least")), "items")
    about = items.agg(F.sum(F.size("words")).alias("positions"), F.collect_set("family").alias("families")).first()  # a handful of numbers
    small = (about["positions"] or 0) <= broadcast_rows
    families = sorted(about["families"]) or [0]
    seeds = None
    for k in families:
        part = _seeds(items.where(F.col("family") == k), ["item_id", "least"], [k])
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = seeds.groupBy("seed").agg(F.collect_set(F.struct("item_id", "least", "position")).alias("places"))
    if small:
        seeds = F.broadcast(seeds)
    row = ["hit_doc", "hit_mark"]  # rows are told apart by id and text
    mark = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("hit_doc"), mark.alias("hit_mark"), words(common.whole_text()).alias("words"))
    found = _seeds(texts, row, families).join(seeds, "seed")
    hits = found.select(*row, "position", F.explode("places").alias("place"))
    hits = hits.select(*row, F.col("place.item_id").alias("item_id"), F.col("place.least").alias("least"), (F.col("position") - F.col("place.position")).alias("diagonal"))
    enough = hits.groupBy(*row, "item_id", "least", "diagonal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("least"))
    hits = common.materialize(enough.select(*row, "item_id", "diagonal"), "hits")
    # A row's hits in groups, with the words of their items
    number = hits.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}")) for c in row]
    grouped = hits.alias("h").join(number.alias("k"), same).select("h.*", F.pmod(F.xxhash64("item_id", "diagonal"), F.ceil(F.col("n") / GROUP)).alias("grp"))
    known = items.select("item_id", F.col("words").alias("item_words"))
    with_words = grouped.join(F.broadcast(known) if small else known, "item_id")
    groups = with_words.groupBy(*row, "grp").agg(F.collect_list(F.struct("item_id", "diagonal", "item_words")).alias("hits")).drop("grp")
    carried = with_words.agg(F.sum(F.size("item_words"))).first()[0] or 0
    if carried <= broadcast_rows:
        groups = F.broadcast(groups)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), mark.alias("m"), "text")
    pairs = texts.join(groups, F.col("d").eqNullSafe(F.col("hit_doc")) & (F.col("m") == F.col("hit_mark"))).withColumn("words", words(common.whole_text()))
    scored = pairs.select(*row, F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), agreement(F.col("words"), h, window).alias("overlap"))).alias("hits"))
    each = scored.select(*row, F.inline("hits")).groupBy(*row).agg(F.array_sort(F.collect_set(F.when(F.col("overlap") >= share, F.col("item_id")))).alias("hit_items"), F.max("overlap").alias("hit_overlap"))
    verdicts = common.materialize(each, "verdicts")
    if carried <= broadcast_rows:  # no more rows than hits
        verdicts = F.broadcast(verdicts)
    doc, text, found, overlap = common.unlike(docs.columns, *verdicts.columns)
    verdicts = verdicts.toDF(doc, text, found, overlap)
    out = docs.join(verdicts, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (mark == F.col(text)), "left")
    return out.select(*docs.columns, F.coalesce(found, F.array().cast("array<bigint>")).alias(into[0]), F.coalesce(overlap, F.lit(0.0)).alias(into[1]))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items", F.round("overlap", 6).alias("overlap"))
