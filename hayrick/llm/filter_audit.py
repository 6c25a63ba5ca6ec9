"""Interaction audit of document filters from a histogram of failure masks.

Every filter is a bit. One pass over the texts gives each document its failure mask by
native expressions and the SHA-256 of its text; grouping by that digest gives the smallest
doc_id of every text, which decides the duplicate filter. From then on a document is its
part, its mask and two label flags, so the table shrinks to 32 cells a part, and whatever
an order of filters would keep or remove is a sum over cells. All 120 orders cost one
expansion of 32 rows a part, whatever the number of documents.

Odd input. A null text is the empty one, a null lang the part "". A row with a null doc_id
has no smaller doc_id and no labels: it never fails the duplicate filter and makes no other
row a duplicate. Rows of one doc_id are each counted; only a smaller doc_id makes a
duplicate, so rows equal in doc_id and text don't remove each other. Several label rows of
a doc_id count as one that has each mark any of them has. An empty table gives no rows. Other columns
aren't read, whatever their names. Very long texts are read whole.

Skew. The digest's groups, the doc_ids of label rows and the cells are combined before the shuffle.
The join that finds a text's first rows is by digest and doc_id, so the copies of one text
are spread; rows without a doc_id are spread by their digest.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common

#: Fixed values of the query: the filters in the order of their bits, the last for duplicates.
LETTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (short), B (repetitive), C (capitals), D (symbols)."""
    blanks = F.translate(text, "\t\n\x0b\x0c\r", "     ")  # so that split needs no pattern
    words = F.array_remove(F.split(blanks, " "), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    ]


def masked(docs: DataFrame, failures: Sequence[Column], part: Column) -> DataFrame:
    """part, doc_id, digest and mask of every row, with the duplicate filter as the highest bit; written out once."""
    text = common.whole_text()
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(failures)]
    rows = docs.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    rows = common.materialize(rows, "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    found = rows.join(firsts, ["digest", "doc_id"], "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return found.select("part", "doc_id", "digest", (F.col("mask") + F.when(repeated, F.lit(1 << len(failures))).otherwise(F.lit(0))).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic: documents of each part and mask, those labelled quality 1, those labelled toxic 1."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("key IS NOT NULL").withColumn("known", F.lit(True))
    keyed = masks.select("part", "mask", F.coalesce("doc_id", F.xxhash64("digest")).alias("key"), F.col("doc_id").isNotNull().alias("known"))
    found = keyed.join(marks, ["key", "known"], "left")
    return found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("good", "toxic")))


def orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every order of the filters keeps and removes at each step, from the cells of each part.

    A document is removed at the step of its first failing filter. Over all orders each of
    its j failing filters is the first equally often, so that a filter's removals over all
    of them are a sum of n * orders / j, without enumeration.
    """
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    every = ["".join(p) for p in permutations(letters)]
    plan = [{"filter_order": order, "step": k + 1, "bit": bits[order[k]], "prefix": sum(bits[c] for c in order[:k])} for order in every for k in range(len(order))]
    # A constant of orders x letters rows: the expansion doesn't depend on the documents.
    steps = cells.select("*", F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order: string, step: int, bit: int, prefix: int>>")))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("prefix")) != 0

    def total(condition: Column, of: str | Column = "n") -> Column:
        return F.sum(F.when(condition, of if isinstance(of, Column) else F.col(of)).otherwise(F.lit(0))).cast("bigint")

    shares = F.expr(f"n * ({len(every)} div greatest(bit_count(mask), 1))")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        total(fails, shares).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """All orders of the five filters over docs, one row a part, order and step."""
    found = masked(docs, text_failures(common.whole_text()), F.col(part))
    return orders(common.materialize(cells(found, labels), "cells"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 100 AS a,
         100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > first_id, false) AS e
  FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
tallies AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
               || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
perms AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM perms),
removals AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, failed, n, n_good, n_toxic,
         contains(failed, substr(filter_order, step, 1)) AS fails,
         len(list_intersect(string_split(failed, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND step > 1 AND failed <> '' AS earlier
  FROM tallies, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM removals GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
