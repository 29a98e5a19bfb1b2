"""Content plan: opportunities clustered into briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.search import empty_array
from brandloom.functions.regex import let
from brandloom.functions.text import content_words, overlap, title_case, without
from brandloom.operators.brands import brand_profile
from brandloom.operators.topics import top_rows


def cluster_keys(opps: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Adds topic and theme: the topic, else the first two content words."""
    lead_words = F.array_join(F.slice(content_words(F.col("query")), 1, 2), " ")
    return opps.withColumn("topic", lexicon.primary_topic(F.col("query"))).withColumn("theme", F.coalesce("topic", lead_words))


def opportunity_clusters(opps: DataFrame, lexicon: Lexicon = HOSPITALITY, limit: int = 8) -> DataFrame:
    """Top clusters per project, with their leading queries. Only bounded lists are
    collected: nine possible signals, six leading queries, four questions."""
    keyed = cluster_keys(opps, lexicon)
    group = ["project_id", "pillar", "theme"]
    place = F.struct((-F.col("score")).alias("neg"), "ord")
    stats = keyed.groupBy(*group).agg(
        F.sum("score").alias("cluster_score"), F.count(F.lit(1)).alias("n_queries"), F.min(place).alias("place"),
        F.min_by(F.struct("query", "page"), place).alias("lead"), F.max("topic").alias("topic"),
        F.collect_set("signals").alias("signal_sets"),
    )
    ranked = top_rows(stats, ["project_id"], [F.desc("cluster_score"), "place"], limit)
    members = keyed.join(ranked.select(*group), group, "left_semi")

    def first_queries(df: DataFrame, k: int, name: str) -> DataFrame:
        top = top_rows(df, group, [F.desc("score"), "ord"], k, rank="nth")
        return top.groupBy(*group).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "query"))), lambda x: x["query"]).alias(name)
        )

    leading = first_queries(members, 6, "leading")
    questions = first_queries(members.filter(F.array_contains("signals", "question")), 4, "questions")
    return (
        ranked.join(leading, group).join(questions, group, "left")
        .select(
            *group, "rank", "cluster_score", "n_queries", "topic", "lead",
            F.array_sort(F.array_distinct(F.flatten("signal_sets"))).alias("signals"),
            F.slice("leading", 2, 5).alias("supporting"), F.coalesce("questions", empty_array()).alias("questions"),
        )
    )


def fact_for(query: Column, topic: Column, pillar: Column) -> Column:
    """Approved fact for a query; expects the brand profile columns in scope."""
    own = content_words(F.concat_ws(" ", F.array_join("brand_names", " "), F.coalesce("city", F.lit(""))))

    def by_words(qw: Column) -> Column:
        scored = F.transform("facts", lambda f, i: F.struct((-F.size(overlap(content_words(f), qw))).alias("neg"), i.alias("i"), f.alias("fact")))
        return F.coalesce(
            let(F.array_min(scored), lambda best: F.when(best["neg"] <= -2, best["fact"])),
            F.when((pillar == "company") & (F.size(qw) == 0), F.get("facts", F.lit(0))),
        )

    return F.coalesce(F.try_element_at("topic_facts", topic), let(without(content_words(query), own), by_words))


def content_plan(opps: DataFrame, brands: DataFrame, lexicon: Lexicon = HOSPITALITY, limit: int = 8) -> DataFrame:
    """One row per brief. At most ``limit`` rows per project meet the brand table."""
    clusters = opportunity_clusters(opps, lexicon, limit)
    c = clusters.join(brand_profile(brands, lexicon), "project_id")
    label = lexicon.label_of(F.col("topic"))
    query, page = F.col("lead.query"), F.col("lead.page")
    has_page = F.coalesce(page, F.lit("")) != ""

    def has(s: str) -> Column:
        return F.array_contains("signals", s)

    action = (
        F.when(has("low CTR for position"), "title_meta_rewrite")
        .when(F.col("pillar") == "competitors", "comparison_page")
        .when(F.col("theme") == "itinerary", "local_guide")
        .when(has("question") & ~has_page, "faq_block")
        .when(has_page & has("striking distance"), "update_existing")
        .otherwise("new_page")
    )
    missing = F.concat(
        F.lit("MISSING: "),
        F.when(label.isNotNull(), F.concat(F.lower(label), F.lit(" details"))).otherwise(F.concat(F.lit("facts that answer “"), query, F.lit("”"))),
    )
    c = c.withColumn("fact", fact_for(query, F.col("topic"), F.col("pillar")))
    return c.select(
        "project_id", "rank",
        title_case(F.when(label.isNotNull(), F.concat(label, F.lit(": "), query)).otherwise(query)).alias("title"),
        action.alias("action"), "pillar", query.alias("primary_query"), F.col("supporting").alias("supporting_queries"),
        F.coalesce(page, F.lit("new")).alias("target_page"), F.col("questions").alias("customer_questions"),
        F.array(F.coalesce("fact", missing)).alias("brand_facts_to_use"),
        F.when(F.col("pillar") == "competitors", F.concat(F.lit("Compare honestly on the points where "), "brand_name", F.lit(" has a documented edge."))).otherwise("").alias("competitor_angle"),
        F.when(F.col("pillar") == "company", "State the fact in one plain sentence with the brand name so AI answers can quote it.")
        .otherwise("Answer the question in the first paragraph; use the searcher's wording in a heading.").alias("geo_note"),
        F.when((F.col("rank") <= 2) | (F.col("cluster_score") > 200), "high").when(F.col("rank") <= 5, "medium").otherwise("low").alias("priority"),
        "cluster_score",
    )


def plan_summary(opps: DataFrame, plan: DataFrame) -> DataFrame:
    """Query counts per pillar and the facts the brand still has to supply."""
    counts = opps.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.count_if(F.col("pillar") == p).alias(p) for p in ("company", "customers", "competitors")],
    )
    facts = plan.select("project_id", "rank", F.explode("brand_facts_to_use").alias("f"))
    per_fact = facts.filter(F.startswith("f", F.lit("MISSING"))).groupBy("project_id", F.regexp_replace("f", "^MISSING:\\s*", "").alias("f")).agg(F.min("rank").alias("r"))
    missing = per_fact.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "f"))), lambda x: x["f"]).alias("missing_brand_facts"))
    briefs = plan.groupBy("project_id").agg(F.count(F.lit(1)).alias("briefs"))
    return counts.join(briefs, "project_id", "left").join(missing, "project_id", "left").select(
        "project_id", "queries", "company", "customers", "competitors", F.coalesce("briefs", F.lit(0)).alias("briefs"),
        F.coalesce("missing_brand_facts", empty_array()).alias("missing_brand_facts"),
    )
