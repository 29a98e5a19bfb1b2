"""Scans of landed files and Parquet sinks, with their SQL. The files are written from the tables
to the session's shared folder first, in the shapes the readers have to cope with."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.session import ensure_checkpoint_dir
from brandloom.sources import serp_json as J
from brandloom.sources.gsc_csv import read_gsc_exports
from brandloom.sources.tables import append_rows, checked_input, replace_by_key, save_results
from brandloom.workload import data as D
from brandloom.workload import sqltext as S


def landing_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"


def titles(spark, sf, size: int) -> DataFrame:
    """Titles and links of ``size`` consecutive pages, as one result page: a list of that length at most."""
    p = D.table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / size).cast("long").alias("s"), (F.col("page_id") % size).cast("int").alias("pos"),
        F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.col("url").alias("link"),
    )
    return p.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "link"))).alias("rs"))


def each(make) -> Column:
    return F.transform("rs", make)


def _value(*cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("value")


def _listed(frames: dict[str, DataFrame], shown: dict[str, list[str]]) -> DataFrame:
    """All frames below each other: frame, serp_id, ord, value."""
    out = None
    for name, cols in shown.items():
        at = F.col("ord") if "ord" in frames[name].columns else F.lit(None).cast("int")
        part = frames[name].select(F.lit(name).alias("frame"), "serp_id", at.alias("ord"), _value(*cols))
        out = part if out is None else out.unionByName(part)
    return out


def scanned_results(spark, sf):
    """Result pages landed as JSON lines and read back. Of seven documents one is cut off, one has
    no key and one a field of another type; places come in both layouts."""
    d = titles(spark, sf, 10)
    s, first = F.col("s"), F.get("rs", F.lit(0))["title"]
    head = [F.when(s % 7 != 5, s.cast("string")).alias("serp_id"), F.lit("prose").alias("project_id"), first.alias("query")]
    hit = lambda r: F.struct(r["title"].alias("title"), r["link"].alias("link"), F.when(r["pos"] % 3 == 0, r["pos"] + 5).alias("position"))
    place = lambda r: F.struct(r["title"].alias("title"), F.when(r["pos"] % 2 == 0, 4.5).alias("rating"), (r["pos"] * 3).alias("reviews"))
    items = F.array(F.struct(F.get("rs", F.lit(1))["title"].alias("snippet")), F.struct(F.lit("").alias("snippet")))
    block = F.array(F.struct(first.alias("snippet"), F.lit(None).cast("array<struct<snippet:string>>").alias("list")), F.struct(F.lit(None).cast("string").alias("snippet"), items.alias("list")))
    body = [
        each(hit).alias("organic_results"), F.transform(F.filter("rs", lambda r: r["pos"] < 4), lambda r: F.struct(F.concat(F.lit("Is "), r["title"]).alias("question"))).alias("related_questions"),
        each(lambda r: F.struct(F.when(r["pos"] % 2 == 0, r["title"]).otherwise("").alias("query"))).alias("related_searches"), each(hit).alias("discussions_and_forums"),
        F.struct(block.alias("text_blocks")).alias("ai_overview"), F.when(s % 3 == 0, F.struct(first.alias("answer"))).alias("answer_box"),
    ]
    flat, nested = F.to_json(F.struct(*head, *body, each(place).alias("local_results"))), F.to_json(F.struct(*head, *body, F.struct(each(place).alias("places")).alias("local_results")))
    line = F.when(s % 7 == 4, F.to_json(F.struct(*head, F.lit("none").alias("organic_results")))).otherwise(F.when(s % 2 == 0, flat).otherwise(nested))
    path = landing_folder(spark)
    d.select(F.when(s % 7 == 6, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    frames, rejects = J.read_serp(spark, path)
    shown = {
        "serps": ["query", "ai_overview", "answer_snippet", "has_answer"], "organic": ["position", "title", "link"], "questions": ["question"], "related": ["text"],
        "forums": ["title", "link"], "places": ["position", "title", "rating", "reviews"],
    }
    lost = rejects.groupBy("reason").agg(F.count(F.lit(1)).cast("int").alias("ord")).select(F.lit("rejects").alias("frame"), F.lit(None).cast("string").alias("serp_id"), "ord", F.col("reason").alias("value"))
    return _listed(frames, shown).unionByName(lost)


def scanned_posts(spark, sf):
    """Forum, site, map and review documents landed as JSON and read back, each list to its length."""
    d = titles(spark, sf, 25)
    comment = lambda r: F.when(r["pos"] % 2 == 0, F.struct(F.struct(F.concat(F.lit("c "), r["title"]).alias("description")).alias("source")))
    hit = lambda r: F.struct(
        r["title"].alias("title"), r["link"].alias("link"), F.when(r["pos"] % 3 == 0, r["title"]).alias("snippet"), F.when(r["pos"] % 5 == 0, "2 years").alias("displayed_meta"),
        F.lit("May 1").alias("date"), comment(r).alias("about_this_result"),
    )
    place = lambda r: F.struct(r["title"].alias("title"), F.struct(r["link"].alias("website")).alias("links"), F.when(r["pos"] % 4 > 0, "w").alias("website"))
    review = lambda r: F.struct(F.when(r["pos"] % 2 == 0, r["title"]).alias("title"), F.when(r["pos"] % 3 == 0, r["link"]).alias("snippet"), F.struct(F.when(r["pos"] % 4 > 0, r["link"]).alias("original")).alias("extracted_snippet"))
    stay = lambda r: F.struct(r["title"].alias("title"), F.concat(F.lit("p"), r["pos"].cast("string")).alias("place_id"), (r["pos"] * 2).alias("reviews"))
    path = landing_folder(spark)
    docs = d.select(F.col("s").cast("string").alias("serp_id"), each(hit).alias("organic_results"), each(place).alias("local_results"), F.lit("Inn").alias("place"), each(review).alias("reviews"), each(stay).alias("places"))
    docs.write.json(path)
    pages = J.read_json(spark, path)
    reviews = J.read_json(spark, path, f"serp_id string, place string, reviews array<{J.REVIEW}>")
    stays = J.read_json(spark, path, f"serp_id string, places {J.TRIPADVISOR_PLACES}")
    frames = {
        "forum": J.forum_posts(pages), "site": J.site_posts(pages, "example"), "maps": J.map_places(pages), "map reviews": J.map_reviews(reviews),
        "tripadvisor reviews": J.tripadvisor_reviews(reviews), "tripadvisor": J.tripadvisor_places(stays),
    }
    shown = {
        "forum": ["title", "snippet", "date"], "site": ["title", "link", "source", "date"], "maps": ["position", "title", "website", "list"], "map reviews": ["source", "place", "text"],
        "tripadvisor reviews": ["source", "place", "text"], "tripadvisor": ["title", "place_id", "reviews"],
    }
    return _listed(frames, shown)


def scanned_exports(spark, sf):
    """Search queries landed as CSV exports of four projects and read back: three layouts, quoted
    cells, figures with separators and percent signs, and one layout without queries."""
    g = D.gsc_queries(spark, sf)
    project = (F.col("ord") % 4).cast("string")
    query = F.concat("query", F.when(F.col("ord") % 10 == 0, ', "new"').otherwise("")).alias("q")
    rate = F.concat((F.floor(F.col("clicks") * 1000 / F.col("impressions")) / 10).cast("string"), F.lit("%"))
    layouts = [
        ("ord % 4 < 2", [query.alias("Top queries"), F.col("clicks").alias("Clicks"), F.col("impressions").alias("Impressions"), rate.alias("CTR"), F.col("position").alias("Position")]),
        ("ord % 4 = 2", [F.col("page").alias("Landing page"), F.col("position").alias("Avg position"), query.alias("Search query"), F.format_number("impressions", 0).alias("Impressions"), F.col("clicks").alias("Clicks")]),
        ("ord % 4 = 3", [F.col("query").alias("Name"), F.col("clicks").alias("Clicks")]),
    ]
    path = landing_folder(spark)
    for i, (which, cells) in enumerate(layouts):
        g.filter(which).select(project.alias("project"), *cells).write.partitionBy("project").option("header", True).option("escape", '"').csv(f"{path}/layout{i}")
    rows, rejects = read_gsc_exports(spark, path, lambda p: F.regexp_extract(p, "project=([^/]+)", 1), lambda p: F.regexp_extract(p, "(layout[0-9])", 1))
    lost = rejects.select(F.concat_ws(": ", "reason", "header").alias("query")).distinct()
    figures = rows.select("project_id", "period_label", "query", "page", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), F.round("position", 3).alias("position"))
    return figures.unionByName(lost, allowMissingColumns=True)


def saved_events(spark, sf):
    """Rows in stored tables: two batches appended, a second result that replaces its types alone,
    and rows of one key replaced in a table of keys."""
    e = D.table(spark, sf, "events").select("event_type", "event_id", "user_id")
    appended, results, keyed = (landing_folder(spark) for _ in range(3))
    for rest in (0, 1):
        append_rows(e.filter(F.col("event_id") % 2 == rest), appended)
    save_results(e, results, ["event_type"])
    save_results(e.filter(F.col("event_type").isin("click", "error") & (F.col("event_id") % 3 == 0)), results, ["event_type"])
    replace_by_key(e.withColumn("shard", F.col("user_id") % 8), keyed, ["shard"])
    replace_by_key(e.filter("user_id % 8 = 3 AND event_id % 5 = 0").withColumn("shard", F.col("user_id") % 8), keyed, ["shard"])
    parts = [spark.read.parquet(p).select(F.lit(n).alias("stored"), "event_type", "event_id") for n, p in (("appended", appended), ("results", results), ("keyed", keyed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("stored", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def input_violations(spark, sf):
    """Parts as form input: trimmed, with defaults, and the fields that break a rule."""
    p = D.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise(" ").alias("kind"), F.col("p_brand").alias("brand"))
    out = checked_input(p, {"name": (9, 14)}, {"kind": 12}, {"brand": ["Brand#11", "Brand#12", "Brand#13"]}, {"kind": "plain"})
    return out.select("p_partkey", "name", "kind", F.array_join("violations", ",").alias("violations"))


QUERIES = {f.__name__: f for f in (scanned_results, scanned_posts, scanned_exports, saved_events, input_violations)}


def _titles(size: int) -> str:
    return f"""t AS (SELECT page_id // {size} AS s, page_id % {size} AS pos, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, url AS link FROM pages),
        o AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY pos) - 1)::INT AS i FROM t)"""


ORACLES = {
    "scanned_results": f"""WITH {_titles(10)}, good AS (SELECT * FROM o WHERE s % 7 NOT IN (4, 5, 6)), top AS (SELECT s, arg_min(title, i) FILTER (i = 0) AS a, arg_min(title, i) FILTER (i = 1) AS b FROM o GROUP BY s)
        SELECT 'organic' AS frame, s::VARCHAR AS serp_id, i AS ord, concat_ws('|', CASE WHEN pos % 3 = 0 THEN pos + 5 ELSE i + 1 END, title, link) AS value FROM good
        UNION ALL SELECT 'forums', s::VARCHAR, i, concat_ws('|', title, link) FROM good UNION ALL SELECT 'questions', s::VARCHAR, i, 'Is ' || title FROM good WHERE pos < 4
        UNION ALL SELECT 'related', s::VARCHAR, i, title FROM good WHERE pos % 2 = 0 AND title <> '' UNION ALL SELECT 'places', s::VARCHAR, i, concat_ws('|', i + 1, title, CASE WHEN pos % 2 = 0 THEN '4.5' END, pos * 3) FROM good
        UNION ALL SELECT 'serps', s::VARCHAR, NULL, concat_ws('|', a, CASE WHEN s % 7 <> 4 THEN nullif(concat_ws(chr(10), nullif(a, ''), '- ' || nullif(b, '')), '') END, CASE WHEN s % 7 <> 4 AND s % 3 = 0 THEN a END, (s % 7 <> 4 AND s % 3 = 0)::VARCHAR) FROM top WHERE s % 7 < 5
        UNION ALL SELECT 'rejects', NULL, count(*)::INT, CASE s % 7 WHEN 4 THEN 'unexpected types' WHEN 5 THEN 'no serp_id' ELSE 'not JSON' END FROM top WHERE s % 7 >= 4 GROUP BY 4""",
    "scanned_posts": f"""WITH {_titles(25)}, r AS (SELECT *, coalesce(CASE WHEN pos % 3 = 0 THEN link END, CASE WHEN pos % 4 > 0 THEN link END, '') AS said,
          concat_ws(' — ', nullif(CASE WHEN pos % 2 = 0 THEN title END, ''), nullif(CASE WHEN pos % 3 = 0 THEN link END, '')) AS told FROM o)
        SELECT 'forum' AS frame, s::VARCHAR AS serp_id, i AS ord, concat_ws('|', title, nullif(concat_ws(' | ', nullif(CASE WHEN pos % 3 = 0 THEN title END, ''), CASE WHEN pos % 2 = 0 THEN 'Top comment: c ' || title END), ''), CASE WHEN pos % 5 = 0 THEN '2 years' ELSE 'May 1' END) AS value FROM o WHERE i < 12
        UNION ALL SELECT 'site', s::VARCHAR, i, concat_ws('|', title, coalesce(link, ''), 'example', 'May 1') FROM o WHERE i < 10
        UNION ALL SELECT 'maps', s::VARCHAR, i, concat_ws('|', i + 1, title, CASE WHEN pos % 4 > 0 THEN 'w' ELSE link END, 'maps') FROM o WHERE i < 20
        UNION ALL SELECT 'map reviews', s::VARCHAR, i, concat_ws('|', 'Google', 'Inn', said) FROM r WHERE i < 10 AND said <> ''
        UNION ALL SELECT 'tripadvisor reviews', s::VARCHAR, i, concat_ws('|', 'Tripadvisor', 'Inn', told) FROM r WHERE i < 15 AND told <> ''
        UNION ALL SELECT 'tripadvisor', s::VARCHAR, i, concat_ws('|', title, 'p' || pos, pos * 2) FROM o WHERE i < 15""",
    "scanned_exports": f"""WITH {S.GSC}
        SELECT (ord % 4)::VARCHAR AS project_id, CASE WHEN ord % 4 < 2 THEN 'layout0' ELSE 'layout1' END AS period_label, query || CASE WHEN ord % 10 = 0 THEN ', "new"' ELSE '' END AS query, CASE WHEN ord % 4 = 2 THEN page END AS page,
          clicks, impressions, CASE WHEN ord % 4 < 2 THEN round(floor(clicks * 1000 / impressions) / 10 / 100, 6) END AS ctr, round(position, 3) AS position FROM gsc WHERE ord % 4 < 3
        UNION ALL (SELECT DISTINCT NULL, NULL, 'no query column: Name,Clicks', NULL, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM gsc WHERE ord % 4 = 3)""",
    "saved_events": """WITH r AS (SELECT 'appended' AS stored, * FROM events UNION ALL SELECT 'results', * FROM events WHERE event_type NOT IN ('click', 'error') OR event_id % 3 = 0 UNION ALL SELECT 'keyed', * FROM events WHERE user_id % 8 <> 3 OR event_id % 5 = 0)
        SELECT stored, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY ALL""",
    "input_violations": """WITH f AS (SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_partkey % 3 > 0 THEN trim(p_type) ELSE 'plain' END AS kind, p_brand FROM part)
        SELECT p_partkey, name, kind, concat_ws(',', CASE WHEN length(name) NOT BETWEEN 9 AND 14 THEN 'name' END, CASE WHEN length(kind) > 12 THEN 'kind' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'brand' END) AS violations FROM f""",
}
