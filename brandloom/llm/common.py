"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.session import ensure_checkpoint_dir

# What counts as white space between words, everywhere in this package.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order (built-in functions only)."""
    return F.array_remove(F.split(text, SPACES), "")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for new files in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage, keeps columns prunable and survives lost executors. The folder is the
    session's to clean, like that of checkpoint().
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a stored side for broadcast if a count of it proves that it is small, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Ids that are broadcast as they are. Of more, a filter of FILTER_WORDS rows of 64 bits is broadcast.
FEW_IDS = 100_000
FILTER_WORDS = 1 << 18


def sifted(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be among ids (one column, of the key's type), and those whose key is not.

    What is broadcast for it has the same bound however many ids there are; with more ids more
    rows of others pass as well, so the first frame is to be joined with ids."""
    own, word, bits = (free_name(df, c) for c in ("_hash", "_word", "_bits"))

    def place(h: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS))

    hashes = ids.select(F.xxhash64(ids.columns[0]).alias("_h"))
    words = stored(hashes.groupBy(place(F.col("_h")).alias(word)).agg(F.expr("bit_or(shiftleft(1L, CAST(_h & 63 AS int)))").alias(bits)))
    marked = df.withColumn(own, F.xxhash64(key)).join(F.broadcast(words), place(F.col(own)) == F.col(word), "left")
    may = F.coalesce(F.expr(f"shiftright({bits}, CAST({own} & 63 AS int)) & 1L") == 1, F.lit(False))
    return marked.filter(may).drop(own, word, bits), marked.filter(~may).drop(own, word, bits)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is not among ids (stored; one column, whose name df doesn't have)."""
    same = F.col(key) == F.col(ids.columns[0])
    if ids.count() <= FEW_IDS:
        return df.join(F.broadcast(ids), same, "left_anti")
    may, rest = sifted(df, key, ids)
    return rest.union(may.join(ids, same, "left_anti"))


#: Rows of whole texts that go to a Python worker at once.
TEXT_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size: whole texts are held several times over on their way to a Python worker and back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_BATCH:
        spark.conf.set(key, TEXT_BATCH)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
