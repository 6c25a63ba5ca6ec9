"""Inverted index and BM25, over batches of queries.

Postings, lengths and corpus figures are DataFrames; a batch of queries joins them by term.
Only terms of the queries travel: the postings are filtered by a semi join before they are
scored, scores are summed per query and document before the final ranking.

A batch of up to MOST terms of queries is sent to where the documents are instead (search,
search_phrases): rows of counted terms are scored in their tasks, a bounded number of rows at a
time, and each task keeps the k best of each query. So nothing is shuffled that grows with
queries times documents. Rows that share an id are put together before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hayrick.functions.text import index_tokens
from hayrick.sources import scratch

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms of all queries that are sent to the documents, a repeated term of a query counted once.
MOST = 1 << 16
#: Cells of a task's matrix of terms by rows.
CELLS = 1 << 21
#: Tokens or stored terms that a task looks at together; a document with more is looked at alone.
TOKENS = 1 << 20
#: Scores this near to a query's k-th best are ranked, not dropped.
NEAR = 2e-9


def postings(docs: DataFrame, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """term, id, tf and positions (from 0). Documents are dealt by id first, so texts are shuffled, not postings."""
    dealt = docs.repartition(id_column)
    words = dealt.select(F.col(id_column).alias("id"), F.posexplode(index_tokens(F.col("text")) if tokens is None else tokens).alias("position", "term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def frequencies(docs: DataFrame, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """term, id and tf only: nothing to collect per group."""
    words = docs.select(F.col(id_column).alias("id"), F.explode(index_tokens(F.col("text")) if tokens is None else tokens).alias("term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.size(index_tokens(F.col("text")) if tokens is None else tokens).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: ndocs and avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("ndocs"), F.avg("dl").alias("avgdl"))


def idf(n: Column, ndocs: Column) -> Column:
    raw = F.log((ndocs - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def term_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(queries: DataFrame, freqs: DataFrame, lengths: DataFrame) -> DataFrame:
    """qid, id and score; queries has qid and term, a repeated term counts each time."""
    wanted = queries.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    found = freqs.join(wanted.select("term").distinct(), "term", "left_semi")
    stats = F.broadcast(corpus_stats(lengths))  # one row
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    scored = found.join(df, "term").join(lengths, "id").crossJoin(stats)
    scored = scored.select("term", "id", term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col("ndocs"))).alias("s"))
    return wanted.join(scored, "term").groupBy("qid", "id").agg(F.sum(F.col("s") * F.col("times")).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "qid", score: str = "score", id_column: str = "id", ascending: bool = False) -> DataFrame:
    """The k best rows of each query with their rank; scores equal to nine places tie, the smaller id wins."""
    near = F.round(score, 9)
    order = Window.partitionBy(by).orderBy(near.asc() if ascending else near.desc(), F.col(id_column))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def phrase_frequencies(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """term, id and tf of phrases: how often all their words follow each other. phrases: term (the phrase's name) and words, each once; index: postings with positions.

    Every place of a word votes for where the phrase would begin; a beginning with the votes
    of all words is one. Votes are counted by phrase, row and beginning, so that a frequent
    word's places are spread over all tasks.
    """
    parts = phrases.select("term", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    votes = index.withColumnRenamed("term", "word").drop("tf").join(parts, "word").select("term", "n", "id", "k", F.explode("positions").alias("position"))
    begins = votes.groupBy("term", "n", "id", (F.col("position") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("votes")).where("votes = n")
    return begins.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def asked_frequencies(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """term, id and tf of words and phrases alike, as bm25 takes them: a phrase is a term with a frequency of its own."""
    words = phrases.where(F.size("words") == 1).select("term")
    found = index.select("term", "id", "tf").join(words, "term", "left_semi")
    return found.unionByName(phrase_frequencies(index, phrases.where(F.size("words") > 1)))


def phrase_counts(index: DataFrame, words: list[str]) -> DataFrame:
    """id and tf: how often the words follow each other. index: postings with positions."""
    spots = index.where(F.col("term").isin(words)).select("term", "id", F.explode("positions").alias("position"))
    found = None
    for k, word in enumerate(words):
        here = spots.where(F.col("term") == word).select("id", (F.col("position") - k).alias("start"))
        found = here if found is None else found.join(here, ["id", "start"], "left_semi")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("tf"))


# ------------------------------------------------------------ queries sent to the documents


def _places(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _stretches(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows whose lists hold `most` elements at most, or of one row: what is worked out for them takes several times their size."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _grouped(rows: np.ndarray, codes: np.ndarray, n_rows: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows, and each row's distinct codes with how often it has them."""
    each, times = np.unique(rows * max(1, n_codes) + codes, return_counts=True)
    offsets = np.searchsorted(each // max(1, n_codes), np.arange(n_rows + 1)).astype(np.int32)
    return offsets, (each % max(1, n_codes)).astype(np.int32), times.astype(np.int32)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _stretches(whole, 1, TOKENS)):
        tokens = batch.column(1)
        values, rows = _places(tokens)
        known = values.dictionary_encode()
        offsets, codes, tfs = _grouped(rows, known.indices.to_numpy().astype(np.int64), len(tokens), len(known.dictionary))
        terms = pa.ListArray.from_arrays(offsets, known.dictionary.take(pa.array(codes)))
        dl = pc.list_value_length(tokens).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), dl, terms, pa.ListArray.from_arrays(offsets, pa.array(tfs))], ["id", "dl", "terms", "tfs"])


def counted(docs: DataFrame, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """A row for each of docs, with id, dl, terms (each once) and tfs: terms are counted where their document is."""
    rows = docs.select(F.col(id_column).alias("id"), (index_tokens(F.col("text")) if tokens is None else tokens).alias("t"))
    return rows.mapInArrow(_count_terms, f"id {docs.schema[id_column].dataType.simpleString()}, dl bigint, terms array<string>, tfs array<int>")


def counted_frequencies(index: DataFrame) -> DataFrame:
    """What frequencies() gives, from counted rows."""
    each = index.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("z"))
    return each.groupBy(F.col("z.terms").alias("term"), "id").agg(F.sum("z.tfs").alias("tf"))


def _hits_schema(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}, dl bigint, codes array<int>, tfs array<int>"


def _in_index(index: DataFrame, terms: list[str]) -> DataFrame:
    """Counted rows with those of some terms, by their numbers."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(wanted.value, pa.string())
        for batch in (part for whole in batches for part in _stretches(whole, 2, TOKENS)):
            values, rows = _places(batch.column(2))
            codes = pc.index_in(values, value_set=value_set)
            there = codes.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.searchsorted(rows[there], np.arange(batch.num_rows + 1)).astype(np.int32)
            tfs = batch.column(3).flatten().to_numpy()[there]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, codes.drop_null().cast(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs))], ["id", "dl", "codes", "tfs"])

    return index.select("id", "dl", "terms", "tfs").mapInArrow(kept, _hits_schema(index))


def _prefixes(phrases: list[list[str]], words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Phrases as steps from one beginning to the next by a word: sorted keys and where they lead, step by step; and which phrase ends at a beginning, or -1."""
    number, nodes, steps = {w: i for i, w in enumerate(words)}, {}, []
    for n in range(max(map(len, phrases), default=0)):
        found = {}
        for p in phrases:
            if len(p) > n:
                key = (nodes[tuple(p[:n])] if n else 0) * len(words) + number[p[n]]
                found[key] = nodes.setdefault(tuple(p[: n + 1]), len(nodes))
        keys = np.array(sorted(found), np.int64)
        steps.append((keys, np.array([found[k] for k in keys.tolist()], np.int64)))
    ends = np.full(len(nodes), -1, np.int64)
    for k, p in enumerate(phrases):
        ends[nodes[tuple(p)]] = k
    return steps, ends


def _in_text(docs: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """docs: id and t (tokens in order). Rows with the phrases that they have, by their numbers, and how often."""
    words = sorted({w for p in phrases for w in p})
    shared = docs.sparkSession.sparkContext.broadcast((words, *_prefixes(phrases, words), len(phrases)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, steps, ends, n_phrases = shared.value
        value_set = pa.array(words, pa.string())
        for batch in (part for whole in batches for part in _stretches(whole, 1, TOKENS)):
            values, rows = _places(batch.column(1))
            codes = pc.fill_null(pc.index_in(values, value_set=value_set), -1).to_numpy().astype(np.int64)
            places, at = np.arange(len(codes)), np.zeros(len(codes), np.int64)  # where something begins, and how far it has come
            found_rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, (keys, leads) in enumerate(steps):
                inside = places + n < len(codes)
                places, at = places[inside], at[inside]
                fits = (rows[places + n] == rows[places]) & (codes[places + n] >= 0)
                places, at = places[fits], at[fits]
                key = at * len(words) + codes[places + n]
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                fits = keys[k] == key
                places, at = places[fits], leads[k[fits]]
                whole = ends[at] >= 0
                found_rows.append(rows[places[whole]])
                found.append(ends[at[whole]])
            offsets, which, tfs = _grouped(np.concatenate(found_rows), np.concatenate(found), batch.num_rows, n_phrases)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(batch.column(1)).cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(which)), pa.ListArray.from_arrays(offsets, pa.array(tfs))], ["id", "dl", "codes", "tfs"])

    return docs.select("id", "t").mapInArrow(kept, _hits_schema(docs))


def _by_id(hits: DataFrame) -> DataFrame:
    """A row an id: dls and times (how many of its rows have that length), codes and tfs."""
    one = lambda df: df.select("id", F.filter(F.array("dl"), lambda x: x.isNotNull()).alias("dls"), F.array(F.lit(1).cast("bigint")).alias("times"), "codes", "tfs")
    repeated = scratch.written(hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    if repeated.isEmpty():
        return one(hits)
    same = F.col("id").eqNullSafe(F.col("again"))
    several = hits.join(repeated, same, "left_semi")
    pair = lambda name, value: F.struct(F.col(name).alias("a"), F.col(value).alias("b"))
    dls = several.groupBy("id", "dl").agg(F.count_if(F.col("dl").isNotNull()).alias("n")).groupBy(F.col("id").alias("key")).agg(F.collect_list(F.when(F.col("dl").isNotNull(), pair("dl", "n"))).alias("d"))
    sums = several.select("id", F.explode(F.arrays_zip("codes", "tfs")).alias("z")).groupBy("id", F.col("z.codes").alias("code")).agg(F.sum("z.tfs").cast("int").alias("tf"))
    sums = sums.groupBy("id").agg(F.collect_list(pair("code", "tf")).alias("c"))
    merged = dls.join(sums, F.col("key").eqNullSafe(F.col("id")), "left").select(F.col("key").alias("id"), F.col("d.a").alias("dls"), F.col("d.b").alias("times"), *(F.coalesce(F.col(f"c.{x}"), F.array().cast("array<int>")).alias(name) for x, name in (("a", "codes"), ("b", "tfs"))))
    return one(hits.join(repeated, same, "left_anti")).unionByName(merged)


class _Best:
    """The k best rows of one query, from one stretch of rows after another."""

    def __init__(self, k: int):
        self.k, self.least = k, 0.0
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.flatnonzero((scores > 0) & (scores >= self.least))
        if not len(some):
            return
        ids, scores = np.concatenate([self.ids, ids[some]]), np.concatenate([self.scores, scores[some]])
        order = np.lexsort((ids, -np.round(scores, 9)))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = self.scores.min() - NEAR


def _ranked(hits: DataFrame, n_terms: int, wanted: list[tuple], qid_type, k: int) -> DataFrame:
    """qid, id, score and rank. hits: id, dl, codes, tfs; wanted: qid, number of the term, times."""
    hits = scratch.written(hits, "hits")  # read for the figures and for the scores
    spark = hits.sparkSession
    ndocs, avgdl = corpus_stats(hits).first()
    hits = _by_id(hits)
    df = {r["code"]: r["n"] for r in hits.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more than terms
    weight = {c: max(LEAST_IDF, math.log((ndocs - n + 0.5) / (n + 0.5))) for c, n in df.items()}
    asked: dict = {}
    for qid, code, times in wanted:
        if code in weight:
            asked.setdefault(qid, []).append((code, times * weight[code]))
    plan = [(np.array([c for c, _ in terms]), np.array([w for _, w in terms])) for terms in asked.values()]
    shared = spark.sparkContext.broadcast((list(asked), plan))
    arrow_type = to_arrow_type(qid_type)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plan = shared.value
        kept, most = [_Best(k) for _ in plan], max(1, CELLS // max(1, n_terms))
        for whole in batches:
            for at in range(0, whole.num_rows if plan else 0, most):
                part = whole.slice(at, most)
                codes, rows = _places(part.column(3))
                tf = np.bincount(codes.to_numpy().astype(np.int64) * part.num_rows + rows, part.column(4).flatten().to_numpy(), n_terms * part.num_rows).reshape(n_terms, -1)
                dls, of = _places(part.column(1))
                if not len(of):
                    continue
                single = len(of) == part.num_rows and bool((np.diff(of) == 1).all())
                tf = tf if single else tf[:, of]
                tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls.to_numpy() / avgdl))
                ids = part.column(0).to_numpy()
                if not single:
                    begins = np.flatnonzero(np.diff(of, prepend=-1))
                    tf, ids = np.add.reduceat(tf * part.column(2).flatten().to_numpy(), begins, axis=1), ids[of[begins]]
                for one, (terms, weights) in zip(kept, plan, strict=True):
                    one.offer(ids, weights @ tf[terms])
        if plan and any(len(one.ids) for one in kept):
            each = np.repeat(np.arange(len(names)), [len(one.ids) for one in kept])
            yield pa.RecordBatch.from_arrays([pa.array(names, arrow_type).take(pa.array(each)), pa.array(np.concatenate([one.ids for one in kept])), pa.array(np.concatenate([one.scores for one in kept]))], ["qid", "id", "score"])

    rows = hits.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "dls", F.slice("times", 1, F.size("dls")).alias("times"), "codes", "tfs")
    return top_k(rows.mapInArrow(best, f"qid {qid_type.simpleString()}, id bigint, score double"), k)


def search(queries: DataFrame, index: DataFrame, k: int, tokens=None) -> DataFrame:
    """top_k over bm25, from counted rows; tokens(terms) turns their terms into those that are asked for.

    queries: qid and term, a repeated term counts each time.
    """
    wanted = queries.where("term IS NOT NULL").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    if tokens is not None:
        index = index.withColumn("terms", tokens(F.col("terms")))
    some = wanted.limit(MOST + 1).collect()
    if len(some) > MOST:
        return top_k(bm25(queries, counted_frequencies(index), index.select("id", "dl")), k)
    terms = sorted({r["term"] for r in some})
    number = {t: i for i, t in enumerate(terms)}
    return _ranked(_in_index(index, terms), len(terms), [(r["qid"], number[r["term"]], r["times"]) for r in some], queries.schema["qid"].dataType, k)


def search_phrases(asked: DataFrame, docs: DataFrame, k: int, id_column: str = "doc_id") -> DataFrame:
    """top_k over bm25 with phrases as terms, from texts. asked: qid, term (the phrase's name) and words; a phrase asked for twice counts twice."""
    wanted = asked.groupBy("qid", "term", "words").agg(F.count(F.lit(1)).alias("times"))
    some = wanted.limit(MOST + 1).collect()
    if len(some) > MOST:
        return top_k(bm25(asked.select("qid", "term"), asked_frequencies(postings(docs, id_column), asked.select("term", "words").distinct()), lengths(docs, id_column)), k)
    names = {r["term"]: list(r["words"]) for r in sorted(some, key=lambda r: r["term"])}
    number = {t: i for i, t in enumerate(names)}
    rows = docs.select(F.col(id_column).alias("id"), index_tokens(F.col("text")).alias("t"))
    return _ranked(_in_text(rows, list(names.values())), len(names), [(r["qid"], number[r["term"]], r["times"]) for r in some], asked.schema["qid"].dataType, k)
