"""Review themes: what guests praise or complain about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.names import normalize_name, same_norm
from brandloom.functions.search import empty_array, sentiment
from brandloom.functions.text import ellipsis, sentences
from brandloom.operators.names import first_match
from brandloom.operators.topics import top_rows


def review_sentences(reviews: DataFrame, keys: list[str], lexicon: Lexicon = HOSPITALITY, positive: str = V.POSITIVE_WORDS, negative: str = V.NEGATIVE_WORDS) -> DataFrame:
    """One row per opinionated (review, sentence, topic). ``reviews``: keys, ord, rating, text."""
    parts = reviews.select(*keys, "ord", "rating", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    about = parts.withColumn("topics", lexicon.topics_in(F.col("sentence"))).filter(F.size("topics") > 0)
    held_back = list(lexicon.no_stack)
    if held_back:
        alone = F.size("topics") == 1
        about = about.withColumn("topics", F.when(alone, F.col("topics")).otherwise(F.filter("topics", lambda t: ~t.isin(held_back))))
    felt = about.withColumn("polarity", sentiment(F.col("sentence"), F.col("rating"), positive, negative)).filter(F.col("polarity") != 0)
    return felt.select(*keys, "ord", "pos", "polarity", "sentence", F.posexplode("topics").alias("tpos", "topic"))


def review_themes(
    reviews: DataFrame,
    keys: list[str],
    lexicon: Lexicon = HOSPITALITY,
    limit: int = 6,
    positive: str = V.POSITIVE_WORDS,
    negative: str = V.NEGATIVE_WORDS,
) -> DataFrame:
    """Top themes per key and polarity; a review counts once per theme, and the
    first three sentences serve as examples."""
    said = review_sentences(reviews, keys, lexicon, positive, negative)
    # A review sits in one partition, so this combine is map-side.
    once = said.groupBy(*keys, "polarity", "topic", "ord").agg(F.min(F.struct("pos", "tpos", "sentence")).alias("first"))
    seen = F.struct("ord", F.col("first.pos"), F.col("first.tpos"))
    themes = once.groupBy(*keys, "polarity", "topic").agg(F.count(F.lit(1)).alias("count"), F.min(seen).alias("seen"))
    ranked = top_rows(themes, [*keys, "polarity"], [F.desc("count"), "seen"], limit)
    firsts = top_rows(once, [*keys, "polarity", "topic"], ["ord", F.col("first.pos")], 3, rank="nth")
    examples = firsts.groupBy(*keys, "polarity", "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("first.sentence").alias("s")))), lambda x: ellipsis(x["s"], 160, 157)).alias("examples")
    )
    return ranked.join(examples, [*keys, "polarity", "topic"]).select(
        *keys, "polarity", "rank", "topic", lexicon.label_of(F.col("topic")).alias("label"), "count", "examples"
    )


#: Place list and the label of the reviews that belong to it.
REVIEW_SOURCES = {"maps": "Google", "tripadvisor": "Tripadvisor"}


def review_targets(subjects: DataFrame, places: DataFrame, keys: list[str], lookups: DataFrame | None = None, rivals: int = 2) -> DataFrame:
    """Which places' reviews to read: for the brand (target 0) and its first ``rivals`` competitors
    the first place of the same business in each list. ``subjects``: keys, brand_name,
    competitor_names. ``places``: keys, list, ord, title, ref (the id reviews are asked by).

    ``lookups``: keys, name, list, ord, title, ref of places found by a search for one name; they
    count where the list itself has none, on Maps the first of them even under another name.
    Returns keys, target, name, source, title, ref; a place without a ref gives no row."""
    listed = F.concat(F.array("brand_name"), F.slice(F.coalesce("competitor_names", empty_array()), 1, rivals))
    targets = subjects.select(*keys, F.posexplode(listed).alias("target", "name")).filter(F.col("name") != "")
    lists = tuple(REVIEW_SOURCES)
    hits = first_match(targets.select(*keys, "name"), places, "name", "title", keys, ["ord"], ["ord", "title", "ref"], by="list", values=lists)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("list"), F.col(f"{v}_ord").isNotNull().alias("found"), F.col(f"{v}_title").alias("title"), F.col(f"{v}_ref").alias("ref")) for v in lists]))
    hits = hits.select(*keys, "name", each.alias("h")).select(*keys, "name", "h.*")
    found = hits.filter("found").drop("found")
    if lookups is not None:
        open_ = hits.filter(~F.col("found")).select(*keys, "name", "list")
        same = same_norm(normalize_name(F.col("title")), normalize_name(F.col("name")))
        asked = lookups.join(open_, [*keys, "name", "list"], "left_semi").withColumn("other", ~same).filter((F.col("list") == "maps") | ~F.col("other"))
        first = asked.groupBy(*keys, "name", "list").agg(F.min(F.struct("other", "ord", "title", "ref")).alias("f"))
        found = found.unionByName(first.select(*keys, "name", "list", "f.title", "f.ref"))
    label = F.create_map(*[F.lit(x) for kv in REVIEW_SOURCES.items() for x in kv])
    return (
        targets.join(found.filter(F.coalesce("ref", F.lit("")) != ""), [*keys, "name"])
        .select(*keys, "target", "name", F.element_at(label, F.col("list")).alias("source"), "title", "ref")
    )


def chosen_reviews(targets: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """The reviews of the targets' places: keys, source, place, target (the first that chose the
    place), ord, rating, text. A place that several targets chose, and a review that a place
    lists twice, counts once."""
    chosen = targets.groupBy(*keys, "source", F.col("title").alias("place")).agg(F.min("target").alias("target"))
    once = reviews.groupBy(*keys, "source", "place", "text").agg(F.min(F.struct("ord", "rating")).alias("f"))
    return once.join(chosen, [*keys, "source", "place"]).select(*keys, "source", "place", "target", "f.ord", "f.rating", "text")
