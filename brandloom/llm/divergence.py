"""Quality rules by distribution divergence, in built-in functions only.

A text's histogram of character classes and its histogram of common words are compared with those
of its language by the Jensen-Shannon distance. The references are sums over all texts of the
language that pass the base rules; the common words are those of the largest share within a
language. Texts too short for a stable histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import SPACES, bounded, stored, text_of, words_of

COMMON_WORDS = 64
MIN_WORDS = 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 80
MAX_CHARS_DISTANCE = 0.26
WORDS_BASE, WORDS_NOISE = 0.17, 1.2  # a text of n words may be WORDS_BASE + WORDS_NOISE / sqrt(n) away
# Classes that are taken out of a text one after the other; what is left is the last class.
SYMBOLS = r"[#*$%&|<>]+"
CLASSES = ["[a-z]+", SPACES, "[A-Z]+", r"\p{Ll}+", r"\p{L}+", r"\p{N}+", r"[.,;:?'\"()\-]+", SYMBOLS, "[!]+"]
PLACE_BITS = 30  # no text has more words
MAX_LANGUAGES = 10_000


def with_repeated_words(d: DataFrame) -> DataFrame:
    """n_repeat_words: how many words of w lie in three-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. The low bits of a hash and the window's place make one
    integer; sorted, these bring possible twins together, and only those are compared whole.
    Each step is a column of its own, so that it is made once.
    """
    w, h, packed, twins = (F.col(c) for c in ("w", "_h", "_packed", "_twins"))
    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumn("_h", F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0))))
    places = F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long")))
    d = d.withColumn("_packed", F.when(F.size(F.array_distinct(h)) == F.size(h), F.slice(h, 1, 0)).otherwise(F.sort_array(places)))

    def beside(a: Column, i: Column, same: Callable[[Column], Column]) -> Column:
        return F.coalesce(same(F.get(a, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(F.get(a, i - 1)), F.lit(False))

    close = F.filter(packed, lambda x, i: beside(packed, i, lambda y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0))
    at = F.transform(close, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    d = d.withColumn("_twins", F.sort_array(F.transform(at, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p")))))
    d = d.withColumn("_places", F.sort_array(F.transform(F.filter(twins, lambda x, i: beside(twins, i, lambda y: x["h"] == y["h"])), lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    total = F.aggregate("_places", start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return d.withColumn("n_repeat_words", total.cast("long"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, _lang, t (the text), w (its words), chars (see with_class_counts) and the base measures."""
    d = docs.select("doc_id", F.col("lang").cast("string").alias("_lang"), text_of().alias("t")).withColumn("w", words_of(F.col("t")))
    d = with_class_counts(with_repeated_words(d))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": (F.char_length("t") - F.get("chars", F.lit(CLASSES.index(SPACES)))).cast("long"),
            "n_symbols": F.get("chars", F.lit(CLASSES.index(SYMBOLS))).cast("long"),
            "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        }
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_class_counts(d: DataFrame) -> DataFrame:
    """chars: the characters of t in each class and of the rest, as an array.

    What is left of the text after each class is a column of its own, so that it is made once.
    """
    sizes, left = [], "t"
    for k, c in enumerate(CLASSES):
        d = d.withColumn(f"left{k}", F.regexp_replace(left, c, ""))
        sizes.append((F.char_length(left) - F.char_length(f"left{k}")).cast("double"))
        left = f"left{k}"
    return d.withColumn("chars", F.array(*sizes, F.char_length(left).cast("double")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence to base 2) of two histograms."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(pn: Column, qn: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / pn, (a / pn + b / qn) / 2) + part(b / qn, (a / pn + b / qn) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))

    return F.transform(F.array(F.struct(total(p).alias("p"), total(q).alias("q"))), lambda n: F.when((n["p"] > 0) & (n["q"] > 0), both(n["p"], n["q"])))[0]


def common_words(docs: DataFrame, most: int = COMMON_WORDS) -> list[str]:
    """The words with the largest share of a language's words, lower case, most of them at most."""
    words = docs.select(F.col("lang").cast("string").alias("_lang"), F.explode(words_of(F.lower(text_of()))).alias("word"))
    counts = stored(words.groupBy("_lang", "word").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("word").rlike(r"^\p{L}+$")))
    total = stored(counts.groupBy("_lang").agg(F.sum("n").alias("all")))
    share = counts.join(bounded(total, MAX_LANGUAGES), counts["_lang"].eqNullSafe(total["_lang"])).filter("all >= 1000").groupBy("word").agg(F.max(F.col("n") / F.col("all")).alias("share"))
    return [r["word"] for r in share.orderBy(F.desc("share"), "word").limit(most).select("word").collect()]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    the two distances (null where not judged) for each row of docs (doc_id, text, lang).

    A null text has no words. A null language is one of its own; a language of which no text
    passes the base rules judges nothing. Rows that repeat are judged alike. The list of common
    words is a parameter of bounded length and goes with the plan; other columns are not read.
    """
    words = common_words(docs)
    d = base_counts(docs)
    if words:
        hits = F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(words))
        d = d.withColumn("common", F.transform(F.array(hits), lambda h: F.array(*((F.size(h) - F.size(F.array_remove(h, w))).cast("double") for w in words), (F.col("n_words") - F.size(h)).cast("double")))[0])
    else:
        d = d.withColumn("common", F.array(F.col("n_words").cast("double")))
    rows = stored(d.select("doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars", "common"))

    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)] + [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(len(words) + 1)]
    refs = stored(rows.filter("NOT base_failed").groupBy(F.col("_lang").alias("_l")).agg(*sums)).select("_l", F.array(*(f"c{k}" for k in range(len(CLASSES) + 1))).alias("ref_chars"), F.array(*(f"w{k}" for k in range(len(words) + 1))).alias("ref_common"))
    out = rows.join(bounded(refs, MAX_LANGUAGES), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    out = out.withColumns(
        {
            "chars_distance": F.when(F.aggregate("chars", F.lit(0.0), lambda s, x: s + x) >= MIN_CHARS_JUDGED, distance(F.col("chars"), F.col("ref_chars"))),
            "words_distance": F.when(F.col("n_words") >= MIN_WORDS_JUDGED, distance(F.col("common"), F.col("ref_common"))),
        }
    )
    bad = (F.coalesce("chars_distance", F.lit(0.0)) > MAX_CHARS_DISTANCE) | (F.coalesce("words_distance", F.lit(0.0)) > WORDS_BASE + WORDS_NOISE / F.sqrt(F.greatest("n_words", F.lit(1))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "chars_distance", "words_distance")
