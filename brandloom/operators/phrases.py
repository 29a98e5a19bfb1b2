"""Texts against a table of phrases: many patterns matched by joins on equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.functions.text import words

#: Words in the longest piece that is looked up; longer phrases are chains of pieces.
PIECE = 3


def _ahead(ws: Column) -> Column:
    """Each word with its place and the words after it, NULL beyond the end."""
    return F.transform(ws, lambda w, i: F.struct(i.alias("pos"), *[F.get(ws, i + n).alias(f"w{n}") for n in range(PIECE)]))


def _runs() -> Column:
    """The runs of one to ``PIECE`` words that begin at a word; NULL where the text ends first."""
    return F.array(*[reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"r.w{k}") for k in range(n)]) for n in range(1, PIECE + 1)])


def phrase_pieces(phrases: DataFrame) -> DataFrame:
    """The distinct phrases cut into pieces of at most ``PIECE`` words: phrase, piece, the place of
    the piece (``shift``), how many there are (``total``). Pieces of a longer phrase are all of the
    full length; the last one may overlap the one before. ``phrases``: phrase (words in one string)."""
    n = F.size("ws")
    long = F.array_distinct(F.concat(F.sequence(F.lit(0), n - PIECE, F.lit(PIECE)), F.array(n - PIECE)))
    cut = phrases.select("phrase").distinct().withColumn("ws", F.split("phrase", " ")).withColumn("shifts", F.when(n > PIECE, long).otherwise(F.array(F.lit(0))))
    each = cut.select("phrase", "ws", F.size("shifts").alias("total"), F.explode("shifts").alias("shift"))
    return each.select("phrase", "total", "shift", F.array_join(F.slice("ws", F.col("shift") + 1, F.lit(PIECE)), " ").alias("piece"))


def phrase_matches(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, topic: list[str]) -> DataFrame:
    """Which texts hold which phrases as whole words, case and accents aside: keys, topic, phrase.

    ``phrases``: topic columns, phrase. A text's runs of one to ``PIECE`` words meet the pieces of all
    phrases in one join on equality; a phrase stands where all its pieces stand in line, so no text is
    tried against a phrase it shares no piece with, and neither the number nor the length of phrases
    is limited. Hits of one-piece phrases are combined in each task before the shuffle. Texts or
    phrases without words match nothing; repeated phrases and repeated texts of a key count once."""
    known = phrases.select(*topic, F.array_join(words(F.col("phrase")), " ").alias("phrase")).filter(F.col("phrase") != "").distinct()
    ws = texts.select(*keys, words(F.col(text)).alias("ws"), F.monotonically_increasing_id().alias("_row"))
    each = ws.select(*keys, "_row", F.explode(_ahead(F.col("ws"))).alias("r"))
    runs = each.select(*keys, "_row", F.col("r.pos").alias("pos"), F.explode(_runs()).alias("piece"))
    met = runs.join(phrase_pieces(known), "piece")
    begin = F.when(F.col("total") > 1, F.col("pos") - F.col("shift")).otherwise(0)
    held = met.groupBy(*keys, "_row", "phrase", "total", begin.alias("begin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("total"))
    return held.select(*keys, "phrase").distinct().join(known, "phrase").select(*keys, *topic, "phrase")
