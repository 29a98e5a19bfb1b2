"""Exact deduplication by content-defined chunk recipes, in built-in functions only.

Each text is cut where its own content says so (a pattern that a few characters decide), so
equal texts are cut alike. A chunk gets a 128-bit identifier, and the identifiers are verified:
the distinct chunk texts are counted for each identifier, and a new seed is taken if two texts
share one. Texts are equal when their ordered identifier lists are. A long text is read twice
but moves once at most, as chunks that were made distinct in each task before; everything
after that moves identifier lists of 16 bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import stored, text_of

# A chunk ends at the first such place after MIN_CHUNK characters, or at MAX_CHUNK.
CUT = r"[e-n]\W?\s[a-d]"
MIN_CHUNK, MAX_CHUNK = 768, 4096


def chunks_of(text: Column, cut: str = CUT, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined they give the text. None for an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?{cut}|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column, seed: int, bits: int = 64) -> Column:
    """Two 64-bit hashes; fewer bits are for tests that need collisions."""
    pair = [F.xxhash64(F.lit(f"{seed}/{k}"), chunk) for k in (0, 1)]
    return F.array(*(h if bits == 64 else F.pmod(h, F.lit(1 << bits)) for h in pair))


def shared_identifiers(docs: DataFrame, seed: int, bits: int = 64, **cuts) -> DataFrame:
    """Identifiers that two different chunk texts have; empty if the identifiers are good."""
    chunk = docs.select(F.explode(chunks_of(text_of(), **cuts)).alias("c"))
    texts = chunk.select(identifier(F.col("c"), seed, bits).alias("id"), "c").distinct()
    return texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def recipes(docs: DataFrame, seed: int, bits: int = 64, **cuts) -> DataFrame:
    """doc_id, length in bytes, sha-256 and the ordered chunk identifiers of each text."""
    ids = F.flatten(F.transform(chunks_of(F.col("t"), **cuts), lambda c: identifier(c, seed, bits)))
    return docs.select("doc_id", text_of().alias("t")).select(
        "doc_id", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("text_sha256"), ids.alias("recipe")
    )


def exact_duplicates(docs: DataFrame, bits: int = 64, **cuts) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs (doc_id, text).

    Of equal texts the largest doc_id stays. A null text counts as empty. A null doc_id is
    smaller than any other; in a group with null ids only, keep_id is null and its rows stay.
    Rows that repeat both doc_id and text are one document: they count in group_size one by
    one and are kept or dropped together. Other columns are not read, whatever their names.
    """
    seed = 0
    while not shared_identifiers(docs, seed, bits, **cuts).isEmpty():
        seed, bits = seed + 1, min(64, bits * 2)
    rows = stored(recipes(docs, seed, bits, **cuts).withColumn("key", F.xxhash64("n_bytes", "recipe")))
    # Counted in each task first; only groups of two or more return, so a hot group is one row.
    groups = stored(
        rows.groupBy("key", "n_bytes", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    )
    out = rows.join(groups, ["key", "n_bytes", "recipe"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
