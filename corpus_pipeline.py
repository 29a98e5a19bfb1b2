"""From raw documents to token digests: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.llm import exact_dedup, mixing, near_dup, pieces, quality
from brandloom.llm.common import free_name, stored, table, text_of, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier fitted on the labels of those at hand does not reject.

    Rows that repeat are judged each; a null text is judged like an empty one."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, stored so that it stays the same, and the name of that
    column, which is none of theirs: an id may repeat or be null."""
    row = free_name(docs, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def with_rows(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of docs whose number is in the one column of kept, without the number."""
    gone, kept = docs.select(F.col(row).alias(free_name(docs, "_gone"))), kept.toDF("_kept")
    gone = stored(gone.join(kept, gone[gone.columns[0]] == kept["_kept"], "left_anti"))
    return without(docs, row, gone).drop(row)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, of the largest doc_id; of rows that repeat it, or have none, the first.

    Null texts are empty ones. All columns of docs stay, whatever their names."""
    docs, row = numbered(docs)
    kept = exact_dedup.exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    own = docs.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("sha"), F.col(row).alias("_number"))
    first = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_semi").groupBy("sha").agg(F.min("_number").alias("_number"))
    return with_rows(docs, row, first.select("_number"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: of the least doc_id, or the first row where none has an id.

    Rows are compared by their numbers, so that an id that repeats or is null stands for one text each time.
    All columns of docs stay, whatever their names."""
    docs, row = numbered(docs)
    found = near_dup.near_duplicates(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_r"), "component_id")
    ids = docs.select("doc_id", F.col(row).alias("_number")).join(found, F.col("_number") == F.col("_r"))
    best = F.min_by("_number", F.struct(F.col("doc_id").isNull(), "doc_id", "_number")).alias("_number")
    return with_rows(docs, row, ids.groupBy("component_id").agg(best).select("_number"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice.

    A null source is one of its own; rows with the same or no doc_id go together; other columns
    stay, whatever their names."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the number and digest of its token ids and of the text decoded from them.

    A row for each row; a null text has no ids; other columns are not read."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

# A fitted classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py holds run() and the dedup stages against
# brute force, with the rows that the classifier accepts and the mix as they are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
