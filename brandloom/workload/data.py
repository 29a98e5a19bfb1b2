"""Adapters: the star-schema and text tables seen as brand-content tables.

The test tables hold pseudo-words, so the workload uses its own word lexicons; the
shipped hospitality lexicon is exercised by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.functions.lexicon import Lexicon, Topic
from brandloom.operators.brands import BRAND_SCHEMA
from brandloom.session import spread

PART_WORDS = Lexicon(
    topics=(
        Topic("colour", "Colour", (r"\bred\b", r"\bblue\b")),
        Topic("size", "Size", (r"\bsmall\b", r"\blarge\b"), "Size guide"),
        Topic("heat", "Heat", (r"\bhot\b", r"\bcold\b")),
        Topic("age", "Age", (r"\bnew\b", r"\bold\b"), "Buying guide"),
        Topic("round", "Round parts", (r"\brings?\b", r"\brods?\b", r"\bbolts?\b")),
        Topic("flat", "Flat parts", (r"\bplates?\b", r"\banvils?\b")),
        Topic("moving", "Moving parts", (r"\bgears?\b", r"\bgizmos?\b", r"\bwidgets?\b")),
    ),
    generic=("colour",),
    audience=("heat", "age"),
    staples=("size", "round"),
)

PROSE_WORDS = Lexicon(
    topics=(
        Topic("origin", "Origin", (r"\bfrom\b", r"\bvon\b", r"\bdesde\b")),
        Topic("company", "Company", (r"\bwith (the|this|that)\b", r"\bmit\b", r"\bavec\b"), "Company page"),
        Topic("past", "Past", (r"\bwas (in|on|the)\b", r"\bwar\b")),
        Topic("joined", "Joined words", (r"\bthe[a-z]{3,5}\b", r"\beau[a-z]+\b"), "Word guide"),
        Topic("endings", "Endings", (r"\b[a-z]+tion\b.*\b[a-z]+tion\b", r"\b[a-z]+lich\b")),
        Topic("licence", "Licence", (r"\blicen[cs]e\b", r"\bcopyright\b"), "Licence page"),
        Topic("digits", "Digits", (r"\b\d+\b",)),
    ),
    generic=("joined",),
    audience=("company", "past"),
    staples=("licence", "digits"),
    no_stack=("joined",),
)
PROSE_POSITIVE = r"\b(with|that|une|und|los|for|[a-z]+ing)\b"
PROSE_NEGATIVE = r"\b(was|from|les|der|las|not|[a-z]+ble)\b"


#: Tables whose rows are costly to process.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


BRANDS = [
    {
        "project_id": "parts", "brand_name": "Red Widget", "brand_aliases": ["Red Widgets Hotel"], "website": "https://www.thther.example.org/", "industry": "Parts",
        "city": "Ring", "region": "Rod", "country": "Boltland", "country_code": "bl",
        "brand_facts": "The new anvil is cold\nSmall plates for every bolt; Large economy rings\nRed widget promo gear", "usps": "Old gizmo standard\nHot rods",
        "products": "Blue bolts, medium gears", "target_customers": "Cold buyers; new (and old) buyers, others", "cta_preference": "Order the ring",
        "competitors": [("Blue Gear", "http://blog.ththan.example.net", ["Blue Gears"]), ("Hot Anvil", None, None)],
        "site_pages": [("Small rings", "https://x.example/rings", "page"), ("Old gizmo archive", "https://x.example/gizmo", None), ("Contact", "https://x.example/c", None)],
    },
    {
        "project_id": "prose", "brand_name": "Orre Orre", "brand_aliases": ["The", "Und"], "website": "https://ththre.example.com/", "industry": "Prose",
        "city": "Th", "region": "Ing", "country": "Tion", "country_code": "pr",
        "brand_facts": "The from that with\nThis is from the tion; Erin and thble and thsh", "usps": "Und der die mit\nthe orre orre", "products": "license pages",
        "restricted_claims": "Cannot claim thing\nNever say a erer\nNo ther", "words_to_avoid": "thble, thsh, \"inoran\"\nononst", "words_to_use": "the,rewh, thing\nhehely",
        "target_customers": "With the others\nwas in the past", "cta_preference": "the thing of erer", "english_variant": "American English",
        "competitors": [("Sich Sich", "https://therin.example.net", ["Der", "Die"]), ("Thatin", "spam-farm.example.org", None), ("Orantion", None, ["Hehely"])],
        "site_pages": [("The past", "/the", None), ("with the tion", "/tion", "page")],
    },
]


def brands(spark: SparkSession) -> DataFrame:
    """Two fixed brand profiles: the dimension side of every query."""
    names = BRAND_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(b.get(n) for n in names) for b in BRANDS], BRAND_SCHEMA)


def gsc_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries from order lines: one row per part name, type and brand."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0)).alias("clicks"),
        F.sum(F.col("l_quantity").cast("long")).alias("impressions"),
    )
    j = li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_name", "p_type", "p_brand").agg(
        F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"), F.min("p_partkey").alias("ord")
    )
    lead = F.when(F.col("ord") % 5 == 0, "how to fit ").when(F.col("ord") % 5 == 1, "best ").when(F.col("ord") % 5 == 2, "near ").otherwise("")
    return g.select(
        F.lit("parts").alias("project_id"), "ord",
        F.concat(lead, "p_name", F.lit(" "), F.lower("p_type"), F.when(F.col("ord") % 7 == 0, " vs blue gear").otherwise("")).alias("query"),
        F.when(F.col("ord") % 3 > 0, F.col("p_brand")).alias("page"), "clicks", "impressions",
        F.lit(None).cast("double").alias("ctr"), (F.lit(1.0) + (F.col("ord") % 400) / F.lit(10.0)).alias("position"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content drafts; the keyword is the first two content words."""
    from brandloom.functions.text import first_content_words

    d = table(spark, sf_dir, "documents")
    kw = F.when(F.col("doc_id") % 10 > 0, F.array_join(first_content_words(F.col("text"), 2), " "))
    anchor = F.when(F.col("doc_id") % 3 == 0, "the book").when(F.col("doc_id") % 3 == 1, "see offers").otherwise("a page")
    more = F.when(F.col("doc_id") % 2 == 0, " [y](/tion)").otherwise("")
    return d.select(
        F.col("doc_id").alias("draft_id"), F.lit("prose").alias("project_id"), kw.alias("keyword"), "text", "source", anchor.alias("anchor"), more.alias("more"),
    ).select(
        "draft_id", "project_id",
        F.concat(
            F.lit("# "), F.coalesce(F.concat(F.lit("Is "), "keyword"), F.lit("none\n### three")), F.lit("\n\n"), "text",
            F.lit("\n["), "anchor", F.lit("]("), "source", F.lit(") [x](/y)"), "more",
        ).alias("content"),
        "keyword", F.array(F.lit("Thing"), F.lit("erer"), F.lit("Und der")).alias("required_entities"),
    )


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("prose", 1, "Never call us a rewh."), ("prose", 2, 'Avoid "the of"')], "project_id string, rank int, content string")


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as search results, with all their paragraphs: ten consecutive pages form one result page."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.floor(F.col("page_id") / 10).cast("long").alias("serp_id"), (F.col("page_id") % 10 + 1).cast("int").alias("ord"),
        (F.col("page_id") % 10 + 1).cast("int").alias("position"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("link"), F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1), " ").alias("snippet"),
    )


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return c.select(F.floor(F.col("conv_id") / 4).cast("long").alias("serp_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and unlabelled documents as reviews of their source."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rating = F.when(F.col("quality") == 1, 5.0).when(F.col("quality") == 0, 2.0)
    return d.join(l, "doc_id", "left").select(F.col("source").alias("place"), F.col("doc_id").alias("ord"), rating.alias("rating"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brandloom.operators.documents import index_documents

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("project_id"), F.col("text").alias("content"))
    c = index_documents(d)
    return c.withColumn("chunk_id", F.col("document_id") * 10_000 + F.col("chunk_index"))
