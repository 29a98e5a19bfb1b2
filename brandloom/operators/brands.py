"""Brand profile columns used by every job (one narrow projection per brand)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.names import normalize_name
from brandloom.functions.search import empty_array
from brandloom.functions.text import domain_of, fold, lines

COMPETITOR = "struct<name:string,website:string,aliases:array<string>>"
PAGE = "struct<title:string,url:string,type:string>"

_TEXT = T.StringType()
BRAND_SCHEMA = T.StructType(
    [T.StructField(c, _TEXT) for c in ("project_id", "brand_name")]
    + [T.StructField("brand_aliases", T.ArrayType(_TEXT))]
    + [
        T.StructField(c, _TEXT)
        for c in (
            "website", "industry", "property_type", "city", "region", "country", "country_code", "language", "brand_summary", "usps", "brand_facts",
            "products", "restricted_claims", "tone_of_voice", "sentence_style", "words_to_use", "words_to_avoid", "target_customers", "cta_preference",
            "english_variant",
        )
    ]
    + [T.StructField("serp_location", _TEXT), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [
        T.StructField("competitors", T.ArrayType(T.StructType([T.StructField("name", _TEXT), T.StructField("website", _TEXT), T.StructField("aliases", T.ArrayType(_TEXT))]))),
        T.StructField("site_pages", T.ArrayType(T.StructType([T.StructField(c, _TEXT) for c in ("title", "url", "type")]))),
    ]
)


def brand_profile(brands: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """Adds names, norms, sites, facts and the first approved fact per topic."""
    competitors = F.coalesce("competitors", F.array().cast(f"array<{COMPETITOR}>"))
    sites = F.filter(F.transform(competitors, lambda c: c["website"]), lambda w: F.coalesce(w, F.lit("")) != "")
    b = brands.withColumns(
        {
            "brand_names": F.concat(F.array("brand_name"), F.coalesce("brand_aliases", empty_array())),
            "competitors": competitors,
            "site_pages": F.coalesce("site_pages", F.array().cast(f"array<{PAGE}>")),
            "brand_site": F.when(F.coalesce("website", F.lit("")) != "", domain_of(F.col("website"))),
            "competitor_names": F.transform(competitors, lambda c: c["name"]),
            "competitor_sites": F.transform(sites, domain_of),
            "facts": F.concat(lines(F.col("brand_facts")), lines(F.col("usps")), lines(F.col("products"))),
            "audience": lexicon.audience_topics(F.col("target_customers")),
        }
    ).withColumns(
        {
            "brand_norms": F.transform("brand_names", normalize_name),
            "brand_folds": F.transform("brand_names", fold),
            "competitor_norms": F.transform("competitor_names", normalize_name),
            "fact_topics": F.transform("facts", lexicon.topics_in),
        }
    )
    zipped = F.arrays_zip("facts", "fact_topics")
    first = F.array(
        *[
            F.struct(
                F.lit(t.id).alias("topic"),
                F.get(F.filter(zipped, lambda x: F.array_contains(x["fact_topics"], t.id)), F.lit(0))["facts"].alias("fact"),
            )
            for t in lexicon.topics
        ]
    )
    return b.withColumn("topic_facts", F.map_from_entries(F.filter(first, lambda x: x["fact"].isNotNull())))


def brand_topics(brands: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    """(project_id, topic, fact): the first approved fact about each topic."""
    return brand_profile(brands, lexicon).select("project_id", F.explode("topic_facts").alias("topic", "fact"))
