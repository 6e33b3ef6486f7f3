"""A training corpus from the documents table: quality, exact and near dedup, repeats, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import BATCH_ROWS, materialise, shuffle_partitions, table
from tickvault.llm.exact_dedup import exact_dedup
from tickvault.llm.near_dedup import near_duplicates
from tickvault.llm.packing import best_fit_pack
from tickvault.llm.quality import score, train
from tickvault.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Of the last stages and of SQL: models and tokenizers cannot be stated in it.
ORACLE_SQL = None


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps. Decisions are by doc_id, so where doc_ids
    are repeated or null, each row first gets a number in their order, which is decided on.
    Most rows are kept, so the dropped ids are the smaller side to join."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        dropped = decide(docs).where("not kept").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti")
    last = F.col("doc_id").isNull()
    read = docs.withColumn("_nth", F.monotonically_increasing_id()).withColumn("_last", last)
    rows = materialise(read.repartitionByRange(shuffle_partitions(docs.sparkSession), "_last", "doc_id", "_nth")
                       .sortWithinPartitions("_last", "doc_id", "_nth")
                       .select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-rows")
    dropped = (decide(rows.select(F.col("_row").alias("doc_id"), "text")).where("not kept")
               .select(F.col("doc_id").alias("_row")))
    return rows.join(dropped, "_row", "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not reject (score of at least 0.5)."""
    docs = docs.select(*COLUMNS)
    trees = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(docs, trees, COLUMNS).where("score >= 0.5").drop("score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that are equal but for white space."""
    docs = docs.select(*COLUMNS)
    return _kept(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates
    (five-word shingles, similarity of 0.8 or more)."""
    docs = docs.select(*COLUMNS)
    return _kept(docs, lambda rows: near_duplicates(rows, width=5, percent=80))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out strings of 50 bytes that a document with a smaller doc_id also has. Bytes of
    a code point cut by that are dropped with it; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    cut = remove_repeats(docs, carried=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.char_length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact), ("near dedup", near),
          ("substring dedup", repeats), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{i}")
    return docs
