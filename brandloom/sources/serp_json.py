"""Landed search-result JSON: one document per result page, normalised to frames.

Each reader is a narrow projection per document. Lists keep the length the analysis
uses (first ten results, first twelve threads); the others are read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.session import stored

PLACE = "struct<position:double,title:string,rating:double,reviews:double,type:string,address:string,website:string,links:struct<website:string>,price:string,description:string,data_id:string,place_id:string>"
RESULT = "struct<position:double,title:string,link:string,snippet:string,source:string,date:string,displayed_meta:string,about_this_result:struct<source:struct<description:string>>>"
DOCUMENT = (
    f"serp_id string, project_id string, query string, organic_results array<{RESULT}>, "
    "related_questions array<struct<question:string,snippet:string,link:string>>, related_searches array<struct<query:string>>, "
    f"local_results string, discussions_and_forums array<{RESULT}>, ai_overview struct<text_blocks:array<struct<snippet:string,list:array<struct<snippet:string>>>>>, "
    "answer_box struct<title:string,snippet:string,answer:string>"
)
TRIPADVISOR_PLACES = "array<struct<title:string,place_id:string,rating:double,reviews:double,link:string,location:string,place_type:string>>"
REVIEW = "struct<title:string,snippet:string,rating:double,date:string,extracted_snippet:struct<original:string>>"


def read_json(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """JSON lines with an explicit schema; nested fields of union type stay text."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_serp(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Result pages of many projects, and the records that are not whole.

    Every line is parsed once, and the documents are stored for the frames to read. The second
    frame (path, record, reason) names the lines that are no JSON object or have no serp_id, which
    no frame holds, and the documents with a field of an unexpected type: these stay, the field is
    empty. Blank lines are passed over."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", DOCUMENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    docs = stored(raw.select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("_record"), parsed.alias("d")).select("_path", "_record", "d.*"))
    lost = F.col("serp_id").isNull()
    reason = F.when(lost & F.col("_bad").isNotNull(), "not JSON").when(lost, "no serp_id").otherwise("unexpected types")
    rejects = docs.filter(lost | F.col("_bad").isNotNull()).select(F.col("_path").alias("path"), F.col("_record").alias("record"), reason.alias("reason"))
    return serp_frames(docs.filter(~lost).drop("_path", "_record", "_bad")), rejects


def _rows(df: DataFrame, array: Column, limit: int | None, *fields: Column) -> DataFrame:
    wanted = array if limit is None else F.slice(array, 1, limit)
    listed = df.select("serp_id", F.posexplode_outer(wanted).alias("ord", "r")).filter(F.col("r").isNotNull())
    return listed.select("serp_id", "ord", *fields)


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def _position() -> Column:
    return F.coalesce(F.col("r.position"), F.col("ord") + 1).cast("int").alias("position")


def place_fields() -> list[Column]:
    return [
        _position(), _text("r.title").alias("title"), F.col("r.rating").alias("rating"), F.col("r.reviews").cast("long").alias("reviews"), "r.type", "r.address",
        F.coalesce("r.website", "r.links.website").alias("website"), "r.price", "r.description", "r.data_id", "r.place_id",
    ]


def local_places(text: Column) -> Column:
    """Local results come as a list or as an object that holds ``places``."""
    listed = F.startswith(F.ltrim(text), F.lit("["))
    return F.when(listed, F.from_json(text, f"array<{PLACE}>")).otherwise(F.from_json(text, f"struct<places:array<{PLACE}>>")["places"])


def ai_overview_text(blocks: Column, limit: int = 4000) -> Column:
    """Snippets and list items of the overview, one per line."""
    def block(b: Column) -> Column:
        own = F.when(F.coalesce(b["snippet"], F.lit("")) != "", F.array(b["snippet"])).otherwise(F.array().cast("array<string>"))
        items = F.transform(
            F.filter(F.coalesce(b["list"], F.array().cast("array<struct<snippet:string>>")), lambda li: F.coalesce(li["snippet"], F.lit("")) != ""),
            lambda li: F.concat(F.lit("- "), li["snippet"]),
        )
        return F.concat(own, items)

    return F.nullif(F.substring(F.array_join(F.flatten(F.transform(blocks, block)), "\n"), 1, limit), F.lit(""))


def serp_frames(docs: DataFrame) -> dict[str, DataFrame]:
    """Frames for ``analyse_serp`` from search documents (see ``DOCUMENT``)."""
    d = docs.withColumn("places", local_places(F.col("local_results")))
    post = [_text("r.title").alias("title"), _text("r.link").alias("link"), F.col("r.snippet").alias("snippet"), F.col("r.source").alias("source"), F.col("r.date").alias("date")]
    return {
        "serps": d.select(
            "serp_id", "project_id", "query", ai_overview_text(F.col("ai_overview.text_blocks")).alias("ai_overview"),
            F.coalesce("answer_box.snippet", "answer_box.answer").alias("answer_snippet"), F.col("answer_box").isNotNull().alias("has_answer"),
        ),
        "organic": _rows(d, F.col("organic_results"), 10, _position(), _text("r.title").alias("title"), _text("r.link").alias("link"), F.col("r.snippet").alias("snippet"), F.col("r.source").alias("source")),
        "questions": _rows(d, F.col("related_questions"), None, _text("r.question").alias("question"), F.col("r.snippet").alias("snippet"), F.col("r.link").alias("link")),
        "related": _rows(d, F.col("related_searches"), None, F.col("r.query").alias("text")).filter(F.coalesce("text", F.lit("")) != ""),
        "forums": _rows(d, F.col("discussions_and_forums"), None, *post),
        "places": _rows(d, F.col("places"), None, *place_fields()).withColumn("list", F.lit("local_pack")),
    }


def forum_posts(docs: DataFrame, limit: int = 12) -> DataFrame:
    """Forum search documents: the top comment joins the snippet."""
    comment = F.col("r.about_this_result.source.description")
    parts = F.array(F.col("r.snippet"), F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit("Top comment: "), comment)))
    snippet = F.nullif(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " | "), F.lit(""))
    return _rows(docs, F.col("organic_results"), limit, _text("r.title").alias("title"), _text("r.link").alias("link"), snippet.alias("snippet"), F.col("r.source").alias("source"), F.coalesce("r.displayed_meta", "r.date").alias("date"))


def site_posts(docs: DataFrame, site: str, limit: int = 10) -> DataFrame:
    """Results restricted to one site."""
    return _rows(docs, F.col("organic_results"), limit, _text("r.title").alias("title"), _text("r.link").alias("link"), F.col("r.snippet").alias("snippet"), F.lit(site).alias("source"), F.col("r.date").alias("date"))


def map_places(docs: DataFrame, limit: int = 20) -> DataFrame:
    d = docs.withColumn("places", local_places(F.col("local_results")))
    return _rows(d, F.col("places"), limit, *place_fields()).withColumn("list", F.lit("maps"))


def tripadvisor_places(docs: DataFrame, limit: int | None = 15) -> DataFrame:
    """``docs``: serp_id, places (array of the search's place objects)."""
    d = docs.select("serp_id", F.from_json(F.to_json("places"), TRIPADVISOR_PLACES).alias("places"))
    fields = [_text("r.title").alias("title"), _text("r.place_id").alias("place_id"), F.col("r.rating").alias("rating"), F.col("r.reviews").cast("long").alias("reviews"), "r.link", "r.location", F.col("r.place_type").alias("type")]
    return _rows(d, F.col("places"), limit, *fields).withColumn("list", F.lit("tripadvisor"))


def map_reviews(docs: DataFrame, limit: int = 10) -> DataFrame:
    """``docs``: serp_id, place, reviews array. Text is the snippet or its original."""
    text = F.coalesce("r.snippet", "r.extracted_snippet.original", F.lit(""))
    d = docs.select("serp_id", "place", F.posexplode_outer(F.slice("reviews", 1, limit)).alias("ord", "r"))
    return d.select("serp_id", "ord", F.lit("Google").alias("source"), "place", F.col("r.rating").alias("rating"), F.col("r.date").alias("date"), text.alias("text")).filter(F.col("text") != "")


def tripadvisor_reviews(docs: DataFrame, limit: int = 15) -> DataFrame:
    parts = F.filter(F.array("r.title", "r.snippet"), lambda p: F.coalesce(p, F.lit("")) != "")
    d = docs.select("serp_id", "place", F.posexplode_outer(F.slice("reviews", 1, limit)).alias("ord", "r"))
    return d.select("serp_id", "ord", F.lit("Tripadvisor").alias("source"), "place", F.col("r.rating").alias("rating"), F.col("r.date").alias("date"), F.array_join(parts, " — ").alias("text")).filter(F.col("text") != "")
