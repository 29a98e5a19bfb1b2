"""Search-result analysis: many result pages in, one nested insight row per page.

Input frames (dictionary ``serp``), all keyed by ``serp_id`` with an explicit ``ord``:
serps(serp_id, project_id, query, ai_overview, answer_snippet, has_answer),
organic(title, link, snippet, position), questions(question, snippet), related(text),
forums / reddit(title, link, snippet, source), places(list, position, title, rating,
reviews), reviews(source, place, rating, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.names import any_same, normalize_name, same_norm
from brandloom.functions.search import classify_intent, empty_array, keep_hits, result_format
from brandloom.functions.text import domain_of
from brandloom.operators.brands import brand_profile
from brandloom.operators.entities import extract_entities
from brandloom.operators.names import first_match
from brandloom.operators.questions import merge_questions
from brandloom.operators.reviews import review_themes
from brandloom.session import cut_lineage
from brandloom.operators.topics import (
    TOP_RESULTS, coalesce_text, competitor_angles, result_counts, top_rows, topic_coverage, topic_demand, topic_gaps, wants_rooms,
)

KEY = ["serp_id"]
PROFILE = [
    "project_id", "brand_name", "brand_names", "brand_norms", "brand_folds", "brand_site", "competitor_names", "competitor_sites",
    "city", "region", "country", "industry", "property_type", "audience", "topic_facts",
]


def gather(df: DataFrame, keys: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """Ranked rows (already limited per key) as one array of structs."""
    value = F.struct(*fields) if len(fields) > 1 else F.col(fields[0])
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x["v"]).alias(name))


def serp_subjects(serps: DataFrame, brands: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Each result page with its brand profile."""
    s = serps.join(brand_profile(brands, lexicon).select(*PROFILE), "project_id")
    return s.withColumn("accommodation", wants_rooms(F.col("query"), F.col("industry"), F.col("property_type")))


def serp_features(subjects: DataFrame, serp: dict[str, DataFrame]) -> DataFrame:
    """Which result-page features are present, in a fixed order."""
    s = subjects.select(*KEY, "has_answer", (F.coalesce("ai_overview", F.lit("")) != "").alias("has_ai"))
    present = {
        "pack": serp["places"].filter(F.col("list") == "local_pack"), "asks": serp["questions"], "forums": serp["forums"], "related": serp["related"],
    }
    for name, df in present.items():
        s = s.join(df.select(*KEY).distinct().withColumn(name, F.lit(True)), KEY, "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return s.select(
        *KEY,
        keep_hits(
            (on("has_answer"), "Featured snippet"), (on("has_ai"), "AI Overview"), (on("pack"), "Local pack"), (on("asks"), "People Also Ask"),
            (on("forums"), "Discussions & forums"), (on("related"), "Related searches"),
        ).alias("serp_features"),
    )


def entity_texts(subjects: DataFrame, serp: dict[str, DataFrame], organic: DataFrame) -> DataFrame:
    def part(df: DataFrame, group: int, ord_: Column, text: Column) -> DataFrame:
        return df.select(*KEY, F.struct(F.lit(group).alias("g"), ord_.cast("long").alias("o")).alias("ord"), text.alias("text"))

    def titled(title: str, sep: str) -> Column:
        return F.concat(F.col(title), F.lit(sep), F.coalesce("snippet", F.lit("")))

    return (
        part(organic, 0, F.col("ord"), titled("title", ". "))
        .unionByName(part(serp["questions"], 1, F.col("ord"), titled("question", " ")))
        .unionByName(part(serp["forums"], 2, F.col("ord"), titled("title", ". ")))
        .unionByName(part(subjects, 3, F.lit(0), F.col("ai_overview")))
        .unionByName(part(subjects, 4, F.lit(0), F.col("answer_snippet")))
    )


def page_entities(subjects: DataFrame, serp: dict[str, DataFrame], organic: DataFrame, local_titles: DataFrame, limit: int = 12) -> DataFrame:
    """Entities the texts of a result page keep mentioning, ranked; the brand and its location are
    none. ``local_titles``: serp_id, businesses (names listed on the page)."""
    context = subjects.join(local_titles, KEY, "left").select(
        *KEY, F.array("city", "region", "country").alias("exclude"), F.col("brand_names").alias("exclude_businesses"),
        F.coalesce("businesses", empty_array()).alias("businesses"),
    )
    return extract_entities(entity_texts(subjects, serp, organic), KEY, context, limit=limit)


def required_entities(entities: DataFrame, k: int = 10) -> DataFrame:
    """The ranked entities a draft on the query of their result page should mention."""
    return entities.filter(F.col("rank") <= k)


def question_items(serp: dict[str, DataFrame]) -> DataFrame:
    """Question texts with their source and weight, in one order across sources."""
    def part(df: DataFrame, group: int, text: Column, source: Column, weight: int) -> DataFrame:
        # Positions within a source are small; the group leads the order.
        return df.select(*KEY, (F.lit(group * 1_000_000_000).cast("long") + F.col("ord")).alias("ord"), text.alias("text"), source.alias("source"), F.lit(weight).alias("weight"))

    from_reddit = F.coalesce("source", "link", F.lit("")).rlike("(?i)reddit")
    return (
        part(serp["questions"], 0, F.col("question"), F.lit("People Also Ask"), 2)
        .unionByName(part(serp["related"], 1, F.col("text"), F.lit("Related searches"), 1))
        .unionByName(part(serp["forums"], 2, F.col("title"), F.when(from_reddit, "Reddit").otherwise("Forums"), 1))
        .unionByName(part(serp["reddit"], 3, F.col("title"), F.lit("Reddit"), 1))
    )


def demand_texts(subjects: DataFrame, serp: dict[str, DataFrame]) -> DataFrame:
    def part(df: DataFrame, rank: int, source: str, ord_: Column, text: Column) -> DataFrame:
        return df.select(*KEY, F.lit(source).alias("source"), F.lit(rank).alias("source_rank"), ord_.cast("long").alias("ord"), text.alias("text"))

    post = coalesce_text(F.col("title"), F.col("snippet"))
    return (
        part(subjects, 0, "your query", F.lit(0), F.col("query"))
        .unionByName(part(serp["questions"], 1, "People Also Ask", F.col("ord"), F.col("question")))
        .unionByName(part(serp["related"], 2, "related searches", F.col("ord"), F.col("text")))
        .unionByName(part(serp["forums"], 3, "forums", F.col("ord"), post))
        .unionByName(part(serp["reddit"], 4, "Reddit", F.col("ord"), post))
        .unionByName(part(serp["reviews"], 5, "reviews", F.col("ord"), F.col("text")))
    )


def top_results(organic: DataFrame, subjects: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Result rows with domain, format and the labels of up to four topics."""
    r = organic.join(subjects.select(*KEY, "brand_site", "competitor_sites"), KEY)
    topics = lexicon.topics_in(coalesce_text(F.col("title"), F.col("snippet")))
    r = r.withColumn("domain", domain_of(F.col("link")))
    return r.select(
        *KEY, "ord", "position", "title", "domain",
        result_format(F.col("title"), F.col("link"), F.col("domain"), F.col("brand_site"), F.col("competitor_sites")).alias("format"),
        F.slice(F.transform(topics, lexicon.label_of), 1, 4).alias("angles"),
    )


def content_formats(results: DataFrame) -> DataFrame:
    n = results.groupBy(*KEY, "format").agg(F.count(F.lit(1)).alias("count"), F.min("ord").alias("seen"))
    return top_rows(n, KEY, [F.desc("count"), "seen"], 9).drop("seen")


def brand_presence(subjects: DataFrame, organic: DataFrame, places: DataFrame) -> DataFrame:
    """First position of the brand in the results, the local pack and Maps."""
    site = organic.join(subjects.select(*KEY, "brand_site"), KEY).filter(
        F.col("brand_site").isNotNull() & F.endswith(domain_of(F.col("link")), F.col("brand_site"))
    ).groupBy(*KEY).agg(F.min_by("position", "ord").alias("organic"))
    mine = places.join(subjects.select(*KEY, "brand_norms"), KEY).filter(any_same(F.col("brand_norms"), normalize_name(F.col("title"))))
    local = mine.groupBy(*KEY).agg(
        *[F.min_by(F.when(F.col("list") == kind, F.col("position")), F.when(F.col("list") == kind, F.col("ord"))).alias(name) for kind, name in (("local_pack", "local_pack"), ("maps", "maps"))]
    )
    return subjects.select(*KEY).join(site, KEY, "left").join(local, KEY, "left")


def competitor_names(subjects: DataFrame, places: DataFrame, limit: int = 6, nearby: int = 8) -> DataFrame:
    """Listed competitors, then local results that are neither the brand nor already
    named; at most eight local rows per page enter the fold."""
    local = places.filter(F.col("list").isin("local_pack", "maps"))
    first = top_rows(local, KEY, [F.when(F.col("list") == "local_pack", 0).otherwise(1), "ord"], nearby)
    titles = gather(first, KEY, "rank", ["title"], "nearby")
    s = subjects.select(*KEY, "brand_norms", "competitor_names").join(titles, KEY, "left")
    norms = lambda ns: F.transform(ns, normalize_name)

    def add(names: Column, title: Column) -> Column:
        n = normalize_name(title)
        skip = any_same(F.col("brand_norms"), n) | any_same(norms(names), n)
        return F.when(skip, names).otherwise(F.concat(names, F.array(title)))

    named = F.aggregate(F.coalesce("nearby", empty_array()), F.col("competitor_names"), add)
    return s.select(*KEY, F.slice(named, 1, limit).alias("names"))


def competitor_intel(subjects: DataFrame, places: DataFrame, reviews: DataFrame, brand_themes: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Ratings, ranks, praised and criticised topics per competitor, and the topic
    where the brand can answer a competitor's weakness."""
    names = cut_lineage(competitor_names(subjects, places))
    each = names.select(*KEY, F.posexplode("names").alias("pos", "name"))
    keyed = each.select(*KEY, "name").distinct()
    kinds = ("maps", "local_pack", "tripadvisor")
    hits = first_match(keyed, places, "name", "title", KEY, ["ord"], ["ord", "position", "rating", "reviews"], by="list", values=kinds)
    out = each.join(hits, [*KEY, "name"], "left")
    place = normalize_name(F.col("place"))
    about = reviews.join(names, KEY).select(
        *KEY, "ord", "rating", "text", F.explode(F.filter("names", lambda n: same_norm(normalize_name(n), place))).alias("name")
    )
    themes = cut_lineage(review_themes(about, [*KEY, "name"], lexicon, limit=4))
    good = gather(themes.filter(F.col("polarity") > 0), [*KEY, "name"], "rank", ["label"], "strengths")
    bad = gather(themes.filter(F.col("polarity") < 0), [*KEY, "name"], "rank", ["topic", "label"], "weak")
    praised = brand_themes.filter(F.col("polarity") > 0).groupBy(*KEY).agg(F.collect_set("topic").alias("praised"))
    out = (
        out.join(good, [*KEY, "name"], "left").join(bad, [*KEY, "name"], "left").join(praised, KEY, "left")
        .join(subjects.select(*KEY, "brand_name", "topic_facts"), KEY)
    )
    weak = F.coalesce("weak", F.array().cast("array<struct<topic:string,label:string>>"))
    edge = F.get(F.filter(weak, lambda w: F.map_contains_key("topic_facts", w["topic"]) | F.array_contains(F.coalesce("praised", empty_array()), w["topic"])), F.lit(0))
    low = F.lower(edge["label"])
    fact = F.try_element_at("topic_facts", edge["topic"])
    pitch = (
        F.when(edge.isNull(), "")
        .when(fact.isNotNull(), F.concat(F.lit("Explain "), "brand_name", F.lit("'s advantage on "), low, F.lit(": “"), fact, F.lit("”.")))
        .otherwise(F.concat(F.lit("Guests praise "), "brand_name", F.lit("'s "), low, F.lit("; highlight it where "), "name", F.lit(" is weaker.")))
    )
    return out.select(
        *KEY, "pos", "name", F.coalesce(*[f"{k}_rating" for k in kinds]).alias("rating"), F.coalesce(*[f"{k}_reviews" for k in kinds]).alias("reviews"),
        F.col("maps_position").alias("maps_rank"), F.col("local_pack_position").alias("local_pack_rank"), F.coalesce("strengths", empty_array()).alias("strengths"),
        F.transform(weak, lambda w: w["label"]).alias("weaknesses"), pitch.alias("opportunity"),
    )


def recommendations() -> Column:
    """Templated next steps from the assembled insight columns, in a fixed order."""
    def rec(when: Column, title: Column, pillar: str, why: Column) -> Column:
        return F.when(when, F.struct(title.alias("title"), F.lit(pillar).alias("pillar"), why.alias("why")))

    gaps = F.transform(
        F.slice("missing_opportunities", 1, 3),
        lambda g: F.struct(
            F.concat(g["format"], F.lit(": cover "), F.lower(g["label"]), F.lit(" for “"), F.col("query"), F.lit("”")).alias("title"),
            F.lit("customers").alias("pillar"),
            F.concat(g["reason"], F.when(g["brand_can_answer"], " Your approved facts already support it.").otherwise(" Add supporting facts to the brand profile first.")).alias("why"),
        ),
    )
    n_q = F.size("customer_questions")
    no_pack = F.col("brand_presence.local_pack").isNull()
    edge = F.get(F.filter("competitors", lambda c: c["opportunity"] != ""), F.lit(0))
    rest = F.array_compact(
        F.array(
            rec(n_q >= 4, F.concat(F.lit("Add an FAQ block answering the top "), F.least(n_q, F.lit(6)).cast("string"), F.lit(" customer questions")), "customers",
                F.lit("Direct, self-contained answers are what People Also Ask and AI answers quote.")),
            rec(F.col("brand_presence.organic").isNull() & no_pack,
                F.concat(F.lit("Make "), "brand_name", F.lit(" explicit for this search: brand + "), F.coalesce("city", F.lit("location")), F.lit(" + approved facts in the first 100 words")), "company",
                F.lit("The brand doesn't appear in the organic top 10 or the local pack for this query.")),
            rec(F.array_contains("serp_features", "Local pack") & no_pack, F.lit("Strengthen the Google Business Profile (categories, photos, review replies)"), "company",
                F.lit("A local pack shows for this query and the brand isn't in it.")),
            rec(edge.isNotNull(), F.concat(F.lit("Position against "), edge["name"]), "competitors", edge["opportunity"]),
        )
    )
    return F.concat(gaps, rest)


def analyse_serp(brands: DataFrame, serp: dict[str, DataFrame], lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """One nested row per result page. Every aggregation is keyed by serp_id, so
    the joins reuse one partitioning; each list is limited before it is collected."""
    # Read by many branches below: written once instead of recomputed per branch.
    subjects = cut_lineage(serp_subjects(serp["serps"], brands, lexicon))
    organic = cut_lineage(top_rows(serp["organic"], KEY, ["ord"], TOP_RESULTS).drop("rank"))
    places = serp["places"]
    counts = result_counts(organic, KEY)
    coverage = topic_coverage(organic, KEY, lexicon)
    angles = competitor_angles(coverage, KEY)
    gaps = topic_gaps(subjects, topic_demand(demand_texts(subjects, serp), KEY, lexicon), coverage, counts, KEY, lexicon)
    questions = merge_questions(question_items(serp), KEY, subjects.select(*KEY, "brand_folds"), lexicon=lexicon)
    questions = top_rows(questions, KEY, [F.desc("score"), "ord"], 15)
    local_titles = places.filter(F.col("list").isin("local_pack", "maps")).groupBy(*KEY).agg(F.collect_set("title").alias("businesses"))
    entities = page_entities(subjects, serp, organic, local_titles)
    results = top_results(organic, subjects, lexicon)
    reviews = serp["reviews"]
    themes = cut_lineage(review_themes(reviews, KEY, lexicon))
    own = reviews.join(subjects.select(*KEY, "brand_norms"), KEY).filter(any_same(F.col("brand_norms"), normalize_name(F.col("place")))).drop("brand_norms")
    own_themes = cut_lineage(review_themes(own, KEY, lexicon))
    rivals = competitor_intel(subjects, places, reviews, own_themes, lexicon)
    presence = brand_presence(subjects, organic, places).select(*KEY, F.struct("organic", "local_pack", "maps").alias("brand_presence"))

    def theme_lists(df: DataFrame, base: DataFrame, name: str) -> DataFrame:
        fields = ["topic", "label", "count", "examples"]
        n = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("reviews"))
        pos = gather(df.filter(F.col("polarity") > 0), KEY, "rank", fields, "positive")
        neg = gather(df.filter(F.col("polarity") < 0), KEY, "rank", fields, "negative")
        return n.join(pos, KEY, "left").join(neg, KEY, "left").select(*KEY, F.struct("positive", "negative", "reviews").alias(name))

    out = subjects.withColumn("intent", classify_intent(F.col("query"), F.col("brand_folds")))
    lists = [
        serp_features(subjects, serp),
        gather(entities, KEY, "rank", ["name", "type", "mentions"], "top_entities"),
        gather(angles, KEY, "rank", ["topic", "label", "coverage", "results"], "competitor_angles"),
        gather(gaps, KEY, "rank", ["topic", "label", "reason", "format", "brand_can_answer"], "missing_opportunities"),
        gather(questions, KEY, "rank", ["question", "sources", "intent", "topics", "frequency", "score"], "customer_questions"),
        gather(results, KEY, "ord", ["position", "title", "domain", "format", "angles"], "top_results"),
        gather(content_formats(results), KEY, "rank", ["format", "count"], "content_formats"),
        presence,
        theme_lists(themes, reviews, "review_themes"),
        theme_lists(own_themes, own, "brand_review_themes"),
        gather(rivals, KEY, "pos", ["name", "rating", "reviews", "maps_rank", "local_pack_rank", "strengths", "weaknesses", "opportunity"], "competitors"),
    ]
    for df in lists:
        out = out.join(df, KEY, "left")
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    filled = ["top_entities", "competitor_angles", "missing_opportunities", "customer_questions", "top_results", "content_formats", "competitors"]
    out = out.withColumns({c: F.coalesce(c, F.array().cast(types[c])) for c in filled})
    return out.withColumn("recommendations", recommendations()).select(
        *KEY, "project_id", "query", "intent", "serp_features", "top_entities", "competitor_angles", "missing_opportunities", "customer_questions",
        "top_results", "content_formats", "brand_presence", "review_themes", "brand_review_themes", "competitors", "recommendations",
    )
