"""Content briefs: a result-page insight and a brand profile turned into a plan.

Everything happens inside one row per topic; lists are short by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.regex import js_round, let, trim_ws
from brandloom.functions.search import empty_array
from brandloom.functions.text import content_words, ellipsis, fold, overlap, title_case
from brandloom.operators.brands import brand_profile


def audience_segments(text: Column) -> Column:
    """Segments split at newline, semicolon or a comma outside parentheses."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n|;|,(?![^(]*\))")
    return F.filter(F.transform(parts, trim_ws), lambda s: s != "")


def _line(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _section(heading, *notes: Column) -> Column:
    return F.struct((heading if isinstance(heading, Column) else F.lit(heading)).alias("heading"), F.array(*notes).alias("notes"))


def internal_links(pages: Column, signal: Column, relevant: Column, lexicon: Lexicon, limit: int = 5) -> Column:
    """Site pages ranked by signal words plus twice the relevant topics they share."""
    def scored(p: Column, i: Column) -> Column:
        text = F.concat_ws(" ", p["title"], F.coalesce(p["type"], F.lit("")))

        def row(hit: Column, topics: Column) -> Column:
            why = F.coalesce(lexicon.label_of(F.get(topics, F.lit(0))), F.get(hit, F.lit(0)), F.lit("undefined"))
            return F.struct(
                (-(F.size(hit) + F.size(topics) * 2)).alias("neg"), i.alias("i"), p["title"].alias("title"), p["url"].alias("url"),
                _line("Supports the ", F.lower(why), " angle").alias("reason"),
            )

        return let(overlap(content_words(text), signal), lambda h: let(overlap(lexicon.topics_in(text), relevant), lambda t: row(h, t)))

    good = F.filter(F.transform(pages, scored), lambda x: x["neg"] < 0)
    return F.transform(F.slice(F.array_sort(good), 1, limit), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["reason"].alias("reason")))


def build_briefs(topics: DataFrame, brands: DataFrame, insights: DataFrame, year: int, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """``topics``: project_id, serp_id, topic. One brief row per topic; ``year`` is the
    year shown in titles."""
    profile = brand_profile(brands, lexicon).select(
        "project_id", "brand_name", F.coalesce("city", F.lit("")).alias("city"), "target_customers", "facts", "fact_topics", "topic_facts", "site_pages", "cta_preference"
    )
    b = topics.join(insights.drop("project_id"), "serp_id").join(profile, "project_id")
    brand, city, topic = F.col("brand_name"), F.col("city"), F.col("topic")
    has_city = city != ""

    def fact(t: Column) -> Column:
        return F.try_element_at("topic_facts", t)

    asked = F.flatten(F.transform(F.slice("customer_questions", 1, 8), lambda q: q["topics"]))
    b = b.withColumn("query_topics", F.array_distinct(F.concat(lexicon.topics_in(topic), asked)))
    b = b.withColumns(
        {
            "segments": F.transform(audience_segments(F.col("target_customers")), lambda s: F.struct(s.alias("text"), lexicon.topics_in(s).alias("topics"))),
            "relevant": F.array_distinct(
                F.concat("query_topics", F.transform("competitor_angles", lambda a: a["topic"]), F.transform("missing_opportunities", lambda g: g["topic"]), F.array(F.lit("location")))
            ),
        }
    )
    matching = F.filter("segments", lambda s: F.size(overlap(s["topics"], F.col("query_topics"))) > 0)
    named = F.transform(matching, lambda s: s["text"])
    covered = F.flatten(F.transform(matching, lambda s: s["topics"]))
    extra = F.array_compact(
        F.array(*[F.when(F.array_contains("query_topics", t) & ~F.array_contains(covered, t), F.lit(V.AUDIENCE_LABELS.get(t, t))) for t in lexicon.audience])
    ) if lexicon.audience else empty_array()
    chosen = F.concat(named, extra)
    fallback = F.transform(F.slice("segments", 1, 2), lambda s: s["text"])
    b = b.withColumn("chosen", chosen)
    audience = F.slice(F.transform(F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(fallback), lambda a: ellipsis(a, 80, 77)), 1, 4)

    proofs = F.transform(
        F.arrays_zip("facts", "fact_topics"),
        lambda f, i: let(overlap(f["fact_topics"], F.col("relevant")), lambda t: F.struct((-F.size(t)).alias("neg"), i.alias("i"), f["facts"].alias("fact"), t.alias("topics"))),
    )
    best = F.slice(F.array_sort(F.filter(proofs, lambda x: x["neg"] < 0)), 1, 6)
    points = F.transform(best, lambda x: F.struct(F.array_join(F.transform(x["topics"], lexicon.label_of), " · ").alias("point"), x["fact"].alias("detail")))
    unmet = F.transform(
        F.filter("missing_opportunities", lambda g: ~F.map_contains_key("topic_facts", g["topic"])),
        lambda g: F.struct(g["label"].alias("point"), _line("MISSING: add verified ", F.lower(g["label"]), " details to the brand profile before writing this section.").alias("detail")),
    )
    signal = F.array_distinct(
        F.concat(
            content_words(topic), F.flatten(F.transform("competitor_angles", lambda a: content_words(a["label"]))),
            F.flatten(F.transform(F.slice("top_entities", 1, 6), lambda e: content_words(e["name"]))),
        )
    )

    # --- outline
    quick = _section("Quick answer", _line("Answer “", topic, "” in 2–3 sentences that name ", brand, F.when(has_city, _line(", ", city)).otherwise(""), " and one approved fact."),
                     F.lit("Keep it self-contained so AI answers can quote it."))
    angle_sections = F.transform(
        F.slice("competitor_angles", 1, 4),
        lambda a: _section(
            a["label"], _line(js_round(a["coverage"] * 100).cast("string"), "% of top results cover this: match it."),
            F.coalesce(_line("Proof point: ", fact(a["topic"])), _line("No approved ", F.lower(a["label"]), " fact yet. Keep it factual or ask the client.")),
        ),
    )
    gap_sections = F.transform(
        F.slice("missing_opportunities", 1, 2),
        lambda g: _section(g["label"], _line("Gap: ", g["reason"]), F.coalesce(_line("Proof point: ", fact(g["topic"])), F.lit("Needs client input."))),
    )
    b = b.withColumn("marks", F.slice(F.transform(F.filter("top_entities", lambda e: e["type"].isin("Landmark", "Place")), lambda e: e["name"]), 1, 6))
    marks = F.col("marks")
    nearby = F.when(
        F.size(marks) > 0,
        _section(_line("Nearby: ", F.array_join(F.slice(marks, 1, 3), ", ")), _line("Mention: ", F.array_join(marks, ", "), "."),
                 F.coalesce(_line("Anchor distances to ", brand, ": ", fact(F.lit("location"))), F.lit("Give walking or driving times from the property."))),
    )
    reasons = F.when(F.size("facts") > 0, F.transform(F.slice("facts", 1, 3), lambda f: _line("✓ ", f))).otherwise(F.array(F.lit("Add USPs to the brand profile.")))
    why = F.when(F.col("intent.label").rlike("Commercial|Transactional|Local"), F.struct(_line("Why stay at ", brand).alias("heading"), reasons.alias("notes")))
    faqs = F.when(
        F.size("customer_questions") > 0,
        F.struct(F.lit("FAQs").alias("heading"), F.transform(F.slice("customer_questions", 1, 5), lambda q: q["question"]).alias("notes")),
    )
    has_cta = F.coalesce("cta_preference", F.lit("")) != ""
    call = _section("Call to action", F.when(has_cta, _line("Use the preferred CTA: ", F.col("cta_preference"))).otherwise("End with one clear next step (check availability / plan your stay)."))
    outline = F.concat(F.array(quick), angle_sections, gap_sections, F.array_compact(F.array(nearby, why, faqs, call)))

    listy = F.exists("content_formats", lambda f: f["format"].isin("Listicle", "Guide") & (f["count"] >= 3))
    span = lambda lo, hi: F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max"))
    word_count = F.when(F.col("intent.primary") == "Transactional", span(400, 800)).when(listy, span(1200, 1800)).otherwise(span(800, 1200))

    b = b.withColumns(
        {
            "titled": title_case(trim_ws(F.regexp_replace(topic, V.WS_CLASS + "+", " "))),
            "city_in": F.when(has_city & ~F.contains(fold(topic), fold(city)), _line(" in ", city)).otherwise(""),
        }
    )
    titled, city_in = F.col("titled"), F.col("city_in")
    ideas = F.array(
        _line(titled, city_in, f" ({year}): A Local's Guide"), _line(titled, ": Insider Tips from ", brand), _line(titled, city_in, ": Where to Go, Stay and Eat")
    )
    lead = F.coalesce(_line(" ", F.get("facts", F.lit(0)), "."), F.lit(""))
    meta = F.substring(_line(titled, city_in, ": practical tips, nearby highlights and where to stay.", lead), 1, 158)

    b = b.withColumn("audience", audience)
    first = F.get("audience", F.lit(0))
    checklist = F.concat(
        F.array(_line("Where should I stay for “", topic, "”? → names ", brand, " with a location fact"), _line("Why choose ", brand, "? → at least two approved facts, stated plainly")),
        F.when(first.isNotNull(), F.array(_line("Best option for ", F.lower(first), "? → a sentence that pairs ", brand, " with that audience"))).otherwise(empty_array()),
        F.transform(F.slice("customer_questions", 1, 2), lambda q: _line(q["question"], " → answered in one self-contained paragraph")),
    )
    return b.select(
        "project_id", "serp_id", "topic", brand.alias("brand"), F.col("intent.label").alias("search_intent"), "audience",
        F.transform(F.slice("customer_questions", 1, 10), lambda q: F.struct(q["question"].alias("question"), q["sources"].alias("sources"), q["frequency"].alias("frequency"))).alias("customer_questions"),
        F.transform(F.slice("top_entities", 1, 10), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"))).alias("required_entities"),
        F.transform("competitor_angles", lambda a: F.struct(a["label"].alias("label"), a["coverage"].alias("coverage"))).alias("competitor_angles"),
        F.transform("missing_opportunities", lambda g: F.struct(g["label"].alias("label"), g["reason"].alias("reason"), g["format"].alias("format"))).alias("gaps"),
        F.slice(F.concat(points, unmet), 1, 8).alias("brand_integration"),
        internal_links(F.col("site_pages"), signal, F.col("relevant"), lexicon).alias("internal_links"),
        outline.alias("outline"), ideas.alias("title_ideas"), meta.alias("meta_description"), checklist.alias("geo_checklist"), word_count.alias("word_count"), "top_results",
    )
