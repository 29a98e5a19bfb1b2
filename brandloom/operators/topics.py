"""Topic coverage, demand and gaps over many result pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.regex import ascii_view, matches
from brandloom.functions.text import fold

TOP_RESULTS = 10


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter lets Spark cut each partition to k rows
    before the shuffle, so a hot key costs no more than k rows per task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def coalesce_text(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def result_counts(organic: DataFrame, keys: list[str]) -> DataFrame:
    return organic.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def topic_coverage(organic: DataFrame, keys: list[str], lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Per key and topic: number of results about it and their share. ``organic``
    holds the top results only (columns keys, ord, title, snippet)."""
    n = result_counts(organic, keys)
    hits = organic.select(*keys, "ord", F.posexplode(lexicon.topics_in(coalesce_text(F.col("title"), F.col("snippet")))).alias("_p", "topic"))
    counts = hits.groupBy(*keys, "topic").agg(
        F.count(F.lit(1)).alias("results"), F.min(F.struct("ord", "_p")).alias("first_seen")
    )
    return counts.join(n, keys).select(
        *keys, "topic", lexicon.label_of(F.col("topic")).alias("label"), "results", "n",
        (F.col("results") / F.col("n")).alias("coverage"), "first_seen",
    )


def competitor_angles(coverage: DataFrame, keys: list[str], minimum: float = 0.2, limit: int = 8) -> DataFrame:
    """Topics a fair share of the results is about, most covered first."""
    ranked = top_rows(coverage.filter(F.col("coverage") >= minimum), keys, [F.desc("results"), "first_seen"], limit)
    return ranked.drop("first_seen")


def topic_demand(texts: DataFrame, keys: list[str], lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Per key and topic: the sources asking about it, in order of appearance.
    ``texts``: keys, source, source_rank, ord, text."""
    found = texts.select(*keys, "source", "source_rank", "ord", F.posexplode(lexicon.topics_in(F.col("text"))).alias("_p", "topic"))
    by_source = found.groupBy(*keys, "topic", "source").agg(F.min(F.struct("source_rank", "ord", "_p")).alias("seen"))
    return by_source.groupBy(*keys, "topic").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "source"))), lambda s: s["source"]).alias("sources"),
        F.min("seen").alias("first_seen"),
    )


def wants_rooms(query: Column, industry: Column, property_type: Column) -> Column:
    profile = coalesce_text(industry, property_type)
    return matches(ascii_view(fold(query)), V.ACCOMMODATION_QUERY) | matches(profile, V.ACCOMMODATION_PROFILE, ignore_case=True)


def topic_gaps(
    subjects: DataFrame,
    demand: DataFrame,
    coverage: DataFrame,
    counts: DataFrame,
    keys: list[str],
    lexicon: Lexicon = HOSPITALITY,
    limit: int = 8,
) -> DataFrame:
    """Topics that are wanted but thinly covered, by priority.

    ``subjects``: keys, audience (topics), accommodation (flag), topic_facts (map).
    Contributors are demand, then audience, then staples; the first one words the
    reason, all add to the priority, and an uncovered topic gets one more point."""
    asked = demand.select(
        *keys, "topic", F.struct(F.lit(0).alias("kind"), (-F.col("n_sources")).alias("a"), "first_seen").alias("via"),
        (F.col("n_sources") * 2).alias("points"), F.array_join(F.slice("sources", 1, 3), ", ").alias("detail"),
        F.lit(False).alias("uncovered_only"),
    )

    def listed(kind: int, topics: Column, when: Column, uncovered: bool) -> DataFrame:
        seen = F.struct(F.lit(0).alias("source_rank"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("_p"))
        return subjects.filter(when).select(*keys, F.posexplode(topics).alias("i", "topic")).select(
            *keys, "topic", F.struct(F.lit(kind).alias("kind"), F.col("i").cast("long").alias("a"), seen.alias("first_seen")).alias("via"),
            F.lit(2).cast("long").alias("points"), F.lit(None).cast("string").alias("detail"), F.lit(uncovered).alias("uncovered_only"),
        )

    audience = listed(1, F.col("audience"), F.lit(True), False)
    parts = asked.unionByName(audience)
    if lexicon.staples:
        parts = parts.unionByName(listed(2, F.array(*[F.lit(t) for t in lexicon.staples]), F.col("accommodation"), True))
    known = (
        parts.join(coverage.select(*keys, "topic", "results"), [*keys, "topic"], "left")
        .join(counts, keys, "left")
        .withColumns({"covered": F.coalesce("results", F.lit(0)), "of": F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))})
        .filter((F.col("covered") / F.col("of") < 0.3) & (~F.col("uncovered_only") | (F.col("covered") == 0)))
    )
    label = lexicon.label_of(F.col("topic"))
    thin = F.concat(F.col("covered").cast("string"), F.lit("/"), F.col("of").cast("string"))
    reason = (
        F.when(F.col("via.kind") == 0, F.concat(F.lit("Asked in "), "detail", F.lit(", but only "), thin, F.lit(" top results cover it.")))
        .when(F.col("via.kind") == 1, F.concat(F.lit("Relevant to your audience ("), F.lower(label), F.lit("), but only "), thin, F.lit(" top results cover it.")))
        .otherwise(F.concat(F.lit("None of the top "), F.col("of").cast("string"), F.lit(" results cover it.")))
    )
    gaps = known.withColumn("reason", reason).groupBy(*keys, "topic").agg(
        F.sum("points").alias("points"), F.min_by("reason", "via").alias("reason"), F.min("via").alias("via"), F.max("covered").alias("covered")
    )
    scored = gaps.withColumn("priority", F.col("points") + F.when(F.col("covered") == 0, 1).otherwise(0))
    ranked = top_rows(scored, keys, [F.desc("priority"), "via"], limit)
    return ranked.join(subjects.select(*keys, "topic_facts"), keys).select(
        *keys, "rank", "topic", lexicon.label_of(F.col("topic")).alias("label"), "reason",
        lexicon.format_of(F.col("topic")).alias("format"),
        F.map_contains_key("topic_facts", F.col("topic")).alias("brand_can_answer"), "priority",
    )
