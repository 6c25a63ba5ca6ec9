"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents, and any others that were there. Each stage says what it does to odd rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import common, decontamination, jaccard_join, packing, secrets, toxicity
from hayrick.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.

    Null and empty texts have the score of no distance at all and, where toxic texts are the
    fewer, stay; equal texts go or stay together; very long texts are read whole; an empty
    table stays one; other columns are kept, whatever their names.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    (score,) = common.unlike(docs.columns, "toxicity__score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by a similarity of 0.8 of their five-word shingles one stays.

    It is the one with the smallest doc_id (a null one only if all are null), of several
    with that doc_id one text, of rows equal in both one. Rows are told apart by doc_id and
    text, so another row with a doc_id that stays doesn't save a copy. Rows without words
    (null, empty, blank) link with nothing and stay. Texts are read in place: the rows that
    go are few, and are broadcast up to SPARE_ROWS of them; beyond, the join shuffles.
    """
    spare = common.materialize(jaccard_join.spare(docs), "spare")
    its_id, its_mark, its_times = common.unlike(docs.columns, "spare__doc_id", "spare__mark", "spare__times")
    gone = spare.select(F.col("doc_id").alias(its_id), F.col("mark").alias(its_mark), F.col("times").alias(its_times))
    count = spare.agg(F.count(F.lit(1)), F.max("times")).first()
    gone = F.broadcast(gone) if count[0] <= SPARE_ROWS else gone
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(its_id)) & (jaccard_join.mark() == F.col(its_mark))
    if not count[1]:
        return docs.join(gone, same, "left_anti").select(docs.columns)
    found = docs.join(gone, same, "left")
    repeated = found.where(F.col(its_times) > 1).select(docs.columns).dropDuplicates(["doc_id", "text"])
    return found.where(F.col(its_times).isNull()).select(docs.columns).unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null, empty and blank texts contain nothing and stay; equal texts go or stay together;
    very long texts are searched whole; without items all stay; columns of any name are kept.
    """
    items, overlap = common.unlike(docs.columns, "decontamination__items", "decontamination__overlap")
    found = decontamination.contaminated(docs, common.table(spark, sf_dir, "benchmark"), into=(items, overlap))
    return found.where(F.size(items) == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text.

    All rows stay, also repeated ones. Null texts and their n_chars stay as they are, empty
    ones too; very long texts are cleaned whole; an empty table stays one.
    """
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed into token sequences; one row a piece.

    Null and empty texts are their end id; repeated rows are packed each; only texts longer
    than a sequence are cut; an empty table gives no pieces; other columns aren't returned.
    """
    return packing.pack(docs, tokenizer_path())


#: Rows of two numbers that are broadcast at most: some 50 MB.
SPARE_ROWS = 2_000_000

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Compression, random fields and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
