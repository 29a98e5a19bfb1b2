"""Result-page, entity, question, review and visibility queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.search import links
from brandloom.functions.text import citation_domain
from brandloom.operators import visibility as VIS
from brandloom.operators.entities import entity_candidates, extract_entities
from brandloom.operators.questions import merge_questions
from brandloom.operators.reviews import chosen_reviews, review_targets, review_themes
from brandloom.operators.topics import competitor_angles, result_counts, topic_coverage, topic_demand, topic_gaps
from brandloom.plans import brief, serp as P
from brandloom.workload import data as D
from brandloom.workload import sqltext as S

KEY = ["serp_id"]


def serp_frames(spark, sf) -> dict:
    """Result pages from web pages, questions and forum posts from conversations."""
    organic = D.page_results(spark, sf)
    serps = organic.groupBy("serp_id").agg(F.min_by("title", "ord").alias("t")).select(
        "serp_id", F.lit("prose").alias("project_id"), F.concat(F.lit("best hotels "), F.coalesce("t", F.lit(""))).alias("query"),
        F.when(F.col("serp_id") % 2 == 0, F.concat(F.lit("Overview of Orre Orre. "), "t")).alias("ai_overview"), F.lit(None).cast("string").alias("answer_snippet"), (F.col("serp_id") % 3 == 0).alias("has_answer"),
    )
    none = F.lit(None).cast("string")
    user, assistant, system = (D.turns(spark, sf, r) for r in ("user", "assistant", "system"))
    place = lambda df, kind: df.select(
        "serp_id", F.lit(kind).alias("list"), "ord", (F.col("ord") % 1000 + 1).cast("int").alias("position"), F.substring_index("text", " ", 2).alias("title"),
        (F.length("text") % 5 + 1).cast("double").alias("rating"), F.length("text").alias("reviews"),
    )
    return {
        "serps": serps, "organic": organic,
        "questions": user.select("serp_id", "ord", F.concat(F.lit("Is "), "text").alias("question"), none.alias("snippet")),
        "related": system.select("serp_id", "ord", "text"),
        "forums": assistant.select("serp_id", "ord", F.concat(F.lit("Are "), "text").alias("title"), none.alias("link"), none.alias("snippet"), none.alias("source")),
        "reddit": user.select("serp_id", "ord", F.concat(F.lit("is "), "text").alias("title"), none.alias("link"), none.alias("snippet"), none.alias("source")),
        "places": place(user, "local_pack").unionByName(place(assistant, "maps")).unionByName(place(system, "tripadvisor")),
        "reviews": assistant.select("serp_id", "ord", F.lit("Google").alias("source"), F.substring_index("text", " ", 2).alias("place"), F.lit(4.0).alias("rating"), "text"),
    }


def topic_coverage_by_page(spark, sf):
    c = topic_coverage(D.page_results(spark, sf), KEY, D.PROSE_WORDS)
    return c.select("serp_id", "topic", "label", "results", F.round("coverage", 6).alias("coverage"))


def covered_angles(spark, sf):
    c = competitor_angles(topic_coverage(D.page_results(spark, sf), KEY, D.PROSE_WORDS), KEY)
    return c.select("serp_id", "rank", "topic", "results", "n")


def asked_topics(spark, sf):
    subjects = P.serp_subjects(serp_frames(spark, sf)["serps"], D.brands(spark), D.PROSE_WORDS)
    d = topic_demand(P.demand_texts(subjects, serp_frames(spark, sf)), KEY, D.PROSE_WORDS)
    return d.select("serp_id", "topic", "n_sources", F.array_join("sources", "|").alias("sources"))


def missing_topics(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    gaps = topic_gaps(subjects, topic_demand(P.demand_texts(subjects, f), KEY, D.PROSE_WORDS), topic_coverage(f["organic"], KEY, D.PROSE_WORDS), result_counts(f["organic"], KEY), KEY, D.PROSE_WORDS)
    return gaps.select("serp_id", "rank", "topic", "label", "reason", "format", F.col("brand_can_answer").cast("int").alias("brand_can_answer"), "priority")


def result_formats(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    r = P.top_results(f["organic"], subjects, D.PROSE_WORDS)
    return P.content_formats(r).select("serp_id", "rank", "format", "count")


def brand_positions(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    return P.brand_presence(subjects, f["organic"], f["places"])


def page_features(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    return P.serp_features(subjects, f).select("serp_id", F.array_join("serp_features", "|").alias("features"))


def rival_names(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    return P.competitor_names(subjects, f["places"]).select("serp_id", F.array_join("names", "|").alias("names"))


def reviewed_places(spark, sf):
    """Places whose reviews are read for the brand and two rivals of each result page, and how many there are."""
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    first = [F.min_by("title", F.when(F.col("list") == v, F.col("ord"))) for v in ("maps", "tripadvisor")]
    rivals = f["places"].groupBy("serp_id").agg(F.array_compact(F.array(*first)).alias("competitor_names"))
    named = subjects.select("serp_id", "brand_name").join(rivals, "serp_id", "left")
    places = f["places"].withColumn("ref", F.when(F.col("ord") % 4 > 0, F.col("ord").cast("string")))
    targets = review_targets(named, places, KEY)
    n = chosen_reviews(targets, f["reviews"], KEY).groupBy("serp_id", "source", F.col("place").alias("title")).agg(F.count(F.lit(1)).alias("reviews"))
    return targets.join(n, ["serp_id", "source", "title"], "left").select("serp_id", "target", "name", "source", "title", "ref", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def serp_insights(spark, sf):
    """The whole analysis per result page, nested columns shown as counts and text."""
    i = P.analyse_serp(D.brands(spark), serp_frames(spark, sf), D.PROSE_WORDS)
    return i.select(
        "serp_id", "query", F.col("intent.label").alias("intent"), F.array_join("serp_features", "|").alias("features"), F.to_json("top_entities").alias("entities"),
        F.to_json("competitor_angles").alias("angles"), F.to_json("missing_opportunities").alias("gaps"), F.to_json("customer_questions").alias("questions"),
        F.to_json("competitors").alias("competitors"), F.to_json("recommendations").alias("recommendations"),
    )


def content_briefs(spark, sf):
    i = P.analyse_serp(D.brands(spark), serp_frames(spark, sf), D.PROSE_WORDS)
    topics = i.select("project_id", "serp_id", F.col("query").alias("topic"))
    b = brief.build_briefs(topics, D.brands(spark), i, 2026, D.PROSE_WORDS)
    return b.select("serp_id", "topic", F.to_json("audience").alias("audience"), F.to_json("outline").alias("outline"), F.to_json("internal_links").alias("links"), F.to_json("title_ideas").alias("titles"), "meta_description")


def required_entity_names(spark, sf):
    f = serp_frames(spark, sf)
    subjects = P.serp_subjects(f["serps"], D.brands(spark), D.PROSE_WORDS)
    listed = subjects.select(*KEY, F.array(F.lit("Sich Sich")).alias("businesses"))
    e = P.required_entities(P.page_entities(subjects, f, f["organic"], listed))
    return e.select("serp_id", "rank", "name", "type", "mentions")


def source_entities(spark, sf):
    """Names the documents of each source keep mentioning."""
    d = D.table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    ctx = d.select("source").distinct().select("source", F.array(F.lit("The Ing"), F.lit("Tion")).alias("exclude"), F.array(F.lit("Orre Orre")).alias("exclude_businesses"), F.array(F.lit("Sich Sich")).alias("businesses"))
    return extract_entities(d, ["source"], ctx, limit=15).select("source", "rank", "name", "type", "mentions")


def question_items(spark, sf):
    d = D.table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("source", (F.col("doc_id") * 10_000 + F.col("pos")).alias("ord"), F.col("line").alias("text"), F.when(F.col("pos") == 0, "People Also Ask").otherwise("Forums").alias("from"), F.when(F.col("pos") == 0, 2).otherwise(1).alias("weight"))


def customer_questions(spark, sf):
    """Question-like lines of all documents, merged per document source."""
    i = question_items(spark, sf).withColumnRenamed("source", "k").withColumnRenamed("from", "source")
    qs = merge_questions(i, ["k"], lexicon=D.PROSE_WORDS)
    return qs.select(F.col("k").alias("source_group"), "ord", "question", F.array_join("sources", "|").alias("sources"), F.array_join("topics", "|").alias("topics"), "intent", "frequency", "score")


def review_topics(spark, sf):
    t = review_themes(D.reviews(spark, sf), ["place"], D.PROSE_WORDS, 6, D.PROSE_POSITIVE, D.PROSE_NEGATIVE)
    return t.select("place", "polarity", "rank", "topic", "label", "count", F.md5(F.array_join("examples", "|")).alias("examples_md5"))


# --- AI visibility -------------------------------------------------------------------


def samples(spark, sf):
    """Assistant turns as sampled answers; capitalised names are their mentions."""
    c = D.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    names = entity_candidates(F.col("text"))
    mentions = F.transform(
        names,
        lambda x, i: F.struct(
            x["name"].alias("name"), F.when(i % 4 == 0, "").otherwise(x["name"]).alias("canonical"), (i + 1).alias("position"),
            F.when(i % 3 == 0, "positive").when(i % 3 == 1, "neutral").otherwise("negative").alias("sentiment"), F.lit("").alias("context"),
        ),
    )
    url = F.concat(F.lit("https://www."), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)), F.lit(".example.com/x"))
    cites = F.array(F.struct(url.alias("url"), F.lit("").alias("title"), citation_domain(url).alias("domain")))
    return c.select(
        F.floor(F.col("conv_id") / 4).cast("long").alias("run_id"), (F.col("conv_id") % 4).cast("int").alias("prompt_index"), F.col("turn").cast("int").alias("iteration"),
        mentions.alias("mentions"), cites.alias("citations"), F.when(F.col("turn") == 5, "boom").alias("error"),
    )


def visibility_frames(spark, sf):
    s = samples(spark, sf)
    ids = D.table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 4).cast("long").alias("run_id")).distinct()
    prompt = lambda i: F.struct(F.lit(f"p{i}").alias("prompt"), F.lit(f"angle {i}").alias("angle"))
    plans = ids.select("run_id", F.lit("prose").alias("project_id"), F.array(*[prompt(i) for i in range(4)]).alias("prompts"))
    u = D.turns(spark, sf, "user").withColumnRenamed("serp_id", "run_id")
    places = u.select(
        "run_id", F.when(F.col("ord") % 2 == 0, "maps").otherwise("local_pack").alias("list"), F.col("ord").alias("o"), (F.col("ord") % 1000 + 1).cast("int").alias("position"),
        F.substring_index("text", " ", 1).alias("title"), (F.length("text") % 5 + 1).cast("double").alias("rating"), F.length("text").alias("reviews"),
    ).filter(F.col("title") != "")
    # Position within each list, from the turn order (a handful of turns per run).
    places = places.withColumn("ord", F.row_number().over(Window.partitionBy("run_id", "list").orderBy("o"))).drop("o")
    return D.brands(spark), plans, places, s


def ai_visibility(spark, sf):
    out = VIS.visibility_summary(*visibility_frames(spark, sf), lexicon=D.PROSE_WORDS)
    b = VIS.ranked_businesses(out["businesses"])
    return b.select("run_id", "rank", "name", "role", "ai_mentions", "ai_samples", F.round("ai_mention_rate", 6).alias("ai_mention_rate"), F.round("ai_avg_position", 6).alias("ai_avg_position"), "ai_prompts", "positive", "neutral", "negative", "maps_rank", "local_pack_rank", "gap")


def ai_visibility_summary(spark, sf):
    s = VIS.visibility_summary(*visibility_frames(spark, sf), lexicon=D.PROSE_WORDS)["summary"]
    return s.select("run_id", "total_samples", "successful_samples", F.round("avg_mentions_per_answer", 6).alias("avg_mentions"), F.round("avg_citations_per_answer", 6).alias("avg_citations"), F.col("brand.name").alias("brand"), F.round("brand_share_of_voice", 6).alias("share_of_voice"))


def ai_visibility_prompts(spark, sf):
    p = VIS.visibility_summary(*visibility_frames(spark, sf), lexicon=D.PROSE_WORDS)["per_prompt"]
    return p.select("run_id", "prompt_index", "prompt", F.round("brand_rate", 6).alias("brand_rate"), F.array_join("top", "|").alias("top"))


def cited_domains(spark, sf):
    brands, plans, _, s = visibility_frames(spark, sf)
    return VIS.cited_domains(s, VIS.run_profiles(plans, brands, D.PROSE_WORDS))


def deduped_citations(spark, sf):
    """Links of each page, the first of every address."""
    p = D.table(spark, sf, "pages").select("page_id", F.posexplode(links(F.col("html"))).alias("ord", "l")).select("page_id", "ord", "l.url", F.col("l.text").alias("title"))
    d = VIS.dedupe_citations(p, ["page_id"])
    return d.select("page_id", "url", "ord", F.md5("title").alias("title_md5"))


QUERIES = {f.__name__: f for f in (
    topic_coverage_by_page, covered_angles, asked_topics, missing_topics, result_formats, brand_positions, page_features, rival_names, reviewed_places, serp_insights, content_briefs,
    required_entity_names, source_entities, customer_questions, review_topics, ai_visibility, ai_visibility_summary, ai_visibility_prompts, cited_domains, deduped_citations,
)}

L = D.PROSE_WORDS
ORGANIC = """organic AS (SELECT page_id // 10 AS serp_id, (page_id % 10 + 1)::INT AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS link, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' ') AS snippet FROM pages),
tops AS (SELECT serp_id, ord, title, link, {T} AS ts FROM organic),
cov AS (SELECT serp_id, topic, count(*) AS results, min(ord * 100 + pos) AS seen FROM (SELECT serp_id, ord, unnest(ts) AS topic, unnest(range(len(ts))) AS pos FROM tops) GROUP BY ALL),
n AS (SELECT serp_id, count(*) AS n FROM organic GROUP BY serp_id)""".replace("{T}", S.topics(S.fold("title || ' ' || snippet"), L))
SUBJECTS = """subj AS (SELECT serp_id, 'best hotels ' || arg_min(title, ord) AS query FROM organic GROUP BY serp_id)"""
TURNS = """turns AS (SELECT conv_id // 4 AS serp_id, conv_id * 1000 + turn AS ord, role, text FROM conversations)"""
DEMAND = f"""asked AS (
  SELECT serp_id, 'your query' AS source, 0 AS sr, 0 AS ord, query AS text FROM subj
  UNION ALL SELECT serp_id, 'People Also Ask', 1, ord, 'Is ' || text FROM turns WHERE role = 'user' UNION ALL SELECT serp_id, 'related searches', 2, ord, text FROM turns WHERE role = 'system'
  UNION ALL SELECT serp_id, 'forums', 3, ord, 'Are ' || text FROM turns WHERE role = 'assistant' UNION ALL SELECT serp_id, 'Reddit', 4, ord, 'is ' || text FROM turns WHERE role = 'user'
  UNION ALL SELECT serp_id, 'reviews', 5, ord, text FROM turns WHERE role = 'assistant'),
found AS (SELECT serp_id, source, sr, ord, unnest(ts) AS topic, unnest(range(len(ts))) AS pos FROM (SELECT *, {S.topics(S.fold('text'), L)} AS ts FROM asked)),
bysrc AS (SELECT serp_id, topic, source, min((sr, ord, pos)) AS seen FROM found GROUP BY ALL),
demand AS (SELECT serp_id, topic, count(*) AS n_sources, list(source ORDER BY seen) AS sources, min(seen) AS seen FROM bysrc GROUP BY ALL)"""
_THIN = "covered || '/' || n_"
GAPS = f"""facts AS (SELECT DISTINCT unnest({S.topics(S.fold('f'), L)}) AS topic FROM (VALUES ('The from that with'), ('This is from the tion'), ('Erin and thble and thsh'), ('Und der die mit'), ('the orre orre'), ('license pages')) v(f)),
parts AS (
  SELECT serp_id, topic, 0 AS kind, -n_sources AS a, seen, n_sources * 2 AS points, array_to_string(sources[1:3], ', ') AS detail, false AS uo FROM demand
  UNION ALL SELECT serp_id, topic, 1, i, (0, 0, 0), 2, NULL, false FROM subj, (VALUES (0, 'company'), (1, 'past')) a(i, topic)
  UNION ALL SELECT serp_id, topic, 2, i, (0, 0, 0), 2, NULL, true FROM subj, (VALUES (0, 'licence'), (1, 'digits')) a(i, topic)),
known AS (SELECT p.*, coalesce(results, 0) AS covered, greatest(coalesce(n, 0), 1) AS n_, {S.label('p.topic', L)} AS lab FROM parts p JOIN subj USING (serp_id) LEFT JOIN cov c ON c.serp_id = p.serp_id AND c.topic = p.topic LEFT JOIN n ON n.serp_id = p.serp_id),
worded AS (SELECT *, CASE kind WHEN 0 THEN 'Asked in ' || detail || ', but only ' || {_THIN} || ' top results cover it.' WHEN 1 THEN 'Relevant to your audience (' || lower(lab) || '), but only ' || {_THIN} || ' top results cover it.'
   ELSE 'None of the top ' || n_ || ' results cover it.' END AS why FROM known WHERE covered::DOUBLE / n_ < 0.3::DOUBLE AND (NOT uo OR covered = 0)),
gaps AS (SELECT serp_id, topic, lab, (sum(points) + CASE WHEN max(covered) = 0 THEN 1 ELSE 0 END)::BIGINT AS priority, arg_min(why, (kind, a, seen)) AS reason, min((kind, a, seen)) AS via FROM worded GROUP BY ALL)"""
FORMAT = f"""CASE WHEN domain LIKE '%ththre.example.com' THEN 'Brand page' WHEN domain LIKE '%therin.example.net' OR domain LIKE '%spam-farm.example.org' THEN 'Competitor page'
  WHEN regexp_matches(domain, {S.q(V.OTA_DOMAINS)}) THEN 'OTA listing' WHEN regexp_matches(domain || link, {S.q(V.FORUM_RESULT)}) THEN 'Forum thread' WHEN regexp_matches(f, {S.q(V.LISTICLE_TITLE)}) THEN 'Listicle'
  WHEN regexp_matches(f, {S.q(V.COMPARISON_TITLE)}) THEN 'Comparison' WHEN regexp_matches(f, {S.q(V.GUIDE_TITLE)}) THEN 'Guide' WHEN regexp_matches(f, {S.q(V.REVIEW_TITLE)}) OR contains(domain, 'tripadvisor') THEN 'Review' ELSE 'Article / page' END"""
PLACES = f"""places AS (SELECT serp_id, CASE role WHEN 'user' THEN 'local_pack' WHEN 'assistant' THEN 'maps' ELSE 'tripadvisor' END AS list, ord, (ord % 1000 + 1)::INT AS position, array_to_string(string_split(text, ' ')[1:2], ' ') AS title FROM turns),
normed AS (SELECT *, {S.norm('title')} AS tn FROM places)"""
# Norms of the brand names; "The" has none.
_BRAND_NORMS = ["orre orre", "und"]


def _is_brand(x: str) -> str:
    return "(" + " OR ".join(S.same(x, S.q(b)) for b in _BRAND_NORMS) + ")"


def entity_sql(docs: str, exclude: list[str], businesses_out: list[str], limit: int, key: str) -> str:
    """Entity names per key; ``docs`` yields key, ord (comparable), text."""
    run = S.q("\\b([A-Z][\\p{L}'’.-]+(?:\\s+(?:of|the|de|du|la|le|by)\\s+[A-Z][\\p{L}'’.-]+|\\s+[A-Z][\\p{L}'’.-]+){0,4})")
    edge = S.strs(V.ENTITY_EDGE)
    frag = " OR ".join("len(list_filter(string_split(f, ' '), lambda w: w NOT IN (" + S.strs(e.lower().replace(",", " ").split()) + "))) = 0" for e in exclude)
    return f"""docs AS ({docs}),
runs AS (SELECT {key}, ord, unnest(rs) AS run, unnest(range(len(rs))) AS pos FROM (SELECT *, regexp_extract_all(text, {run}, 1) AS rs FROM docs WHERE text <> '')),
split_ AS (SELECT *, string_split_regex(regexp_replace(run, '[.’'']+$', ''), '\\s+') AS ws FROM runs),
flags AS (SELECT *, list_transform(ws, lambda w: replace({S.fold('w')}, '’', chr(39)) IN ({edge})) AS fe, list_transform(ws, lambda w: {S.fold('w')} IN ({edge})) AS be FROM split_),
heads AS (SELECT *, coalesce(list_position(fe, false), 0) AS h FROM flags),
cut AS (SELECT *, CASE WHEN h = 0 THEN []::VARCHAR[] ELSE ws[h:] END AS w1, CASE WHEN h = 0 THEN []::BOOLEAN[] ELSE be[h:] END AS b1 FROM heads),
tails AS (SELECT *, coalesce(list_position(list_reverse(b1), false), 0) AS t FROM cut),
trimmed AS (SELECT {key}, ord, pos, CASE WHEN t = 0 THEN []::VARCHAR[] ELSE w1[:len(w1) - t + 1] END AS parts FROM tails),
named AS (SELECT *, array_to_string(parts, ' ') AS name, {S.fold("array_to_string(parts, ' ')")} AS f FROM trimmed),
kept AS (SELECT * FROM named WHERE length(name) >= 3 AND f NOT IN ({S.strs(V.ENTITY_GENERIC)}) AND NOT regexp_matches(name, '^[0-9]') AND NOT (len(parts) = 1 AND regexp_matches(lower(name), '[''’]s$'))
   AND NOT (len(parts) = 1 AND regexp_matches(f, {S.q(V.ENTITY_BUSINESS)}))),
perdoc AS (SELECT {key}, f, ord, min((pos, name)) AS first FROM kept GROUP BY ALL),
counted AS (SELECT {key}, f, count(*) AS mentions, min((ord, first)) AS seen FROM perdoc GROUP BY {key}, f),
allowed AS (SELECT *, seen[2][2] AS name FROM (SELECT *, {S.norm('f')} AS fn FROM counted) WHERE f NOT IN ({S.strs(e.lower() for e in exclude)}) AND NOT ({' OR '.join(S.same('fn', S.q(b)) for b in businesses_out)}) AND NOT ({frag})),
sizes AS (SELECT {key}, count(*) AS n_docs FROM docs WHERE text <> '' GROUP BY {key}),
whole AS (SELECT a.*, n_docs FROM allowed a JOIN sizes USING ({key}) WHERE NOT EXISTS (SELECT 1 FROM allowed o WHERE o.{key} = a.{key} AND length(o.name) > length(a.name) AND ends_with(' ' || o.f, ' ' || a.f))),
ents AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY mentions DESC, len(string_split(name, ' ')) DESC, seen)::INT AS rank, name,
   CASE WHEN {S.same('fn', S.q('sich sich'))} OR regexp_matches(f, {S.q(V.ENTITY_BUSINESS)}) THEN 'Business' WHEN regexp_matches(f, {S.q(V.ENTITY_LANDMARK)}) THEN 'Landmark' WHEN len(string_split(name, ' ')) = 1 THEN 'Place' ELSE 'Entity' END AS type, mentions
   FROM whole WHERE mentions >= CASE WHEN n_docs >= 6 THEN 2 ELSE 1 END AND len(string_split(name, ' ')) <= 5 QUALIFY rank <= {limit})"""


def _questions() -> str:
    clean = "line"
    for p in V.FORUM_TITLE_SUFFIXES:
        clean = f"regexp_replace({clean}, {S.q('(?i)' + p)}, '')"
    like = S.q("(?i)" + V.QUESTION_LIKE)
    sig = f"array_to_string(list_sort(list_distinct({S.content_words('t')})), ' ')"
    jac = "len(list_intersect(string_split({a}, ' '), string_split({b}, ' ')))::DOUBLE / (len(string_split({a}, ' ')) + len(string_split({b}, ' ')) - len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))))"
    intents = ", ".join(f"CASE WHEN regexp_matches(fq, {S.q(p)}) THEN {S.q(i)} END" for i, p in V.INTENT_PATTERNS)
    return f"""WITH raw AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents),
items AS (SELECT source AS k, doc_id * 10000 + pos AS ord, ls[pos + 1] AS line, CASE WHEN pos = 0 THEN 'People Also Ask' ELSE 'Forums' END AS src, CASE WHEN pos = 0 THEN 2 ELSE 1 END AS weight FROM (SELECT *, unnest(range(len(ls))) AS pos FROM raw)),
asked AS (SELECT * FROM (SELECT k, ord, src, weight, {S.trim(clean)} AS t FROM items) WHERE length(t) >= 8 AND regexp_matches(t, {like})),
sigs AS (SELECT *, {sig} AS g FROM asked),
firsts AS (SELECT k, g, min(ord) AS o FROM sigs WHERE g <> '' GROUP BY k, g),
lists AS (SELECT k, list([g] ORDER BY o) AS gs FROM firsts GROUP BY k),
led AS (SELECT k, list_reduce(gs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda l: {jac.format(a='l', b='x[1]')} >= 0.5)) > 0 THEN acc ELSE list_concat(acc, x) END) AS leaders FROM lists),
assign AS (SELECT f.k, f.g, list_filter(leaders, lambda l: {jac.format(a='l', b='f.g')} >= 0.5)[1] AS lead FROM firsts f JOIN led USING (k)),
members AS (SELECT s.k, s.ord, s.src, s.weight, s.t, CASE WHEN s.g = '' THEN s.ord ELSE fl.o END AS lo FROM sigs s LEFT JOIN assign a ON a.k = s.k AND a.g = s.g LEFT JOIN firsts fl ON fl.k = s.k AND fl.g = a.lead),
merged AS (SELECT k, lo, sum(weight)::BIGINT AS w, arg_min(t, ord) AS t FROM members GROUP BY k, lo),
srcs AS (SELECT k, lo, list(src ORDER BY o) AS ss FROM (SELECT k, lo, src, min(ord) AS o FROM members GROUP BY ALL) GROUP BY k, lo),
qs AS (SELECT m.k, m.lo, w, ss, CASE WHEN ends_with(t, '?') THEN t ELSE t || '?' END AS question FROM merged m JOIN srcs USING (k, lo)),
f AS (SELECT *, {S.fold('question')} AS fq FROM qs),
i AS (SELECT *, {S.topics('fq', L)} AS ts, list_filter([{intents}], lambda x: x IS NOT NULL) AS hits FROM f),
p AS (SELECT *, CASE WHEN list_contains(hits, 'Commercial investigation') AND list_contains(hits, 'Transactional') AND NOT regexp_matches(fq, {S.q(V.INTENT_BOOKING_PATTERN)}) THEN 'Commercial investigation'
   WHEN len(hits) > 0 THEN hits[1] WHEN regexp_matches(fq, {S.q(V.INTENT_FALLBACK_PATTERN)}) THEN 'Commercial investigation' ELSE 'Informational' END AS prim FROM i)
SELECT k AS source_group, lo AS ord, question, array_to_string(ss, '|') AS sources, {S.join('ts')} AS topics,
  CASE WHEN len(ts) > 0 THEN {S.label('ts[1]', L)} || ' · ' || CASE WHEN prim = 'Informational' THEN 'planning' ELSE lower(prim) END ELSE prim END AS intent,
  CASE WHEN w >= 3 OR len(ss) >= 2 THEN 'High' WHEN w >= 2 THEN 'Medium' ELSE 'Low' END AS frequency, w + len(ss) AS score FROM p"""


def _reviews() -> str:
    def count(p):
        return f"len(regexp_extract_all(fs, {S.q(p)}))"

    return f"""WITH r AS (SELECT source AS place, doc_id AS ord, CASE quality WHEN 1 THEN 5.0 WHEN 0 THEN 2.0 END AS rating, {S.sentences('text')} AS ss FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT place, ord, rating, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM r),
f AS (SELECT *, {S.fold('sentence')} AS fs FROM s),
t AS (SELECT *, {S.topics('fs', L)} AS t0, {count(D.PROSE_POSITIVE)} AS np, {count(D.PROSE_NEGATIVE)} AS nn FROM f),
u AS (SELECT *, CASE WHEN len(t0) = 1 THEN t0 ELSE list_filter(t0, lambda x: x <> 'joined') END AS ts, CASE WHEN np > nn THEN 1 WHEN nn > np THEN -1 WHEN rating >= 4 THEN 1 WHEN rating <= 2 THEN -1 ELSE 0 END AS polarity FROM t),
e AS (SELECT place, ord, pos, polarity, sentence, unnest(ts) AS topic, unnest(range(len(ts))) AS tp FROM u WHERE polarity <> 0),
o AS (SELECT place, polarity, topic, ord, min((pos, tp)) AS fp, arg_min(sentence, pos) AS sentence FROM e GROUP BY ALL),
g AS (SELECT place, polarity, topic, count(*) AS count, min((ord, fp)) AS seen, list(CASE WHEN length(sentence) > 160 THEN left(sentence, 157) || '…' ELSE sentence END ORDER BY ord)[1:3] AS ex FROM o GROUP BY ALL)
SELECT place, polarity::INT AS polarity, row_number() OVER (PARTITION BY place, polarity ORDER BY count DESC, seen)::INT AS rank, topic, {S.label('topic', L)} AS label, count, md5(array_to_string(ex, '|')) AS examples_md5 FROM g QUALIFY rank <= 6"""


_PROSE_DOCS = "SELECT source, doc_id AS ord, text FROM documents"
_SERP_DOCS = """SELECT serp_id, (0, ord::BIGINT) AS ord, title || '. ' || snippet AS text FROM organic UNION ALL SELECT serp_id, (1, ord), 'Is ' || text || ' ' FROM turns WHERE role = 'user' AND serp_id IN (SELECT serp_id FROM subj)
  UNION ALL SELECT serp_id, (2, ord), 'Are ' || text || '. ' FROM turns WHERE role = 'assistant' AND serp_id IN (SELECT serp_id FROM subj)
  UNION ALL SELECT serp_id, (3, 0), CASE WHEN serp_id % 2 = 0 THEN 'Overview of Orre Orre. ' || substr(query, 13) END FROM subj"""

_RIVALS = ["Sich Sich", "Thatin", "Orantion"]


def _display(name: str, norm: str) -> str:
    rivals = " ".join(f"WHEN {S.same(norm, S.q(r.lower()))} THEN {S.q(r)}" for r in _RIVALS)
    return f"CASE WHEN {_is_brand(norm)} THEN 'Orre Orre' {rivals} ELSE {name} END"


def _role(norm: str) -> str:
    return f"CASE WHEN {_is_brand(norm)} THEN 'brand' WHEN {' OR '.join(S.same(norm, S.q(r.lower())) for r in _RIVALS)} THEN 'competitor' ELSE 'other' END"


_ANSWERS = "SELECT conv_id * 1000 + turn AS sid, 0 AS ord, text FROM conversations WHERE role = 'assistant'"
_FIRST_PLACE = "(SELECT arg_min({c}, p.ord) FROM places p WHERE p.run_id = t.run_id AND p.list = {l} AND " + S.same("p.tn", "t.bn") + ")"
VISIBILITY = f"""{entity_sql(_ANSWERS, ['zzz'], ['zzz'], 15, 'sid')},
ment AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS i, name FROM kept),
answers AS (SELECT conv_id // 4 AS run_id, (conv_id % 4)::INT AS pi, turn::INT AS it, conv_id * 1000 + turn AS sid, turn = 5 AS failed, lower(regexp_extract(text, '([A-Za-z]+)', 1)) || '.example.com' AS domain FROM conversations WHERE role = 'assistant'),
runs_ AS (SELECT DISTINCT conv_id // 4 AS run_id FROM conversations),
m AS (SELECT run_id, pi, it, sid, i, name, {S.norm('name')} AS nn FROM ment JOIN answers USING (sid) WHERE NOT failed),
users AS (SELECT conv_id // 4 AS run_id, conv_id * 1000 + turn AS o, string_split(text, ' ')[1] AS title, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN 'maps' ELSE 'local_pack' END AS list FROM conversations WHERE role = 'user'),
places AS (SELECT *, (o % 1000 + 1)::INT AS position, {S.norm('title')} AS tn, row_number() OVER (PARTITION BY run_id, list ORDER BY o) AS ord FROM users WHERE title <> ''),
allnames AS (SELECT run_id, name, (0, pi::BIGINT, it::BIGINT, i::BIGINT) AS seen FROM m UNION ALL SELECT run_id, 'Orre Orre', (1, 0, 0, 0) FROM runs_
  UNION ALL SELECT run_id, v.n, (2, v.k, 0, 0) FROM runs_, (VALUES (0, 'Sich Sich'), (1, 'Thatin'), (2, 'Orantion')) v(k, n)
  UNION ALL SELECT run_id, title, (3, CASE list WHEN 'maps' THEN 0 ELSE 1 END, ord, 0) FROM places WHERE list = 'local_pack' OR ord <= 10),
fn AS (SELECT run_id, name, min(seen) AS seen, {_display('name', S.norm('name'))} AS display FROM allnames GROUP BY run_id, name),
nd AS (SELECT *, {S.norm('display')} AS dn FROM fn),
norms AS (SELECT run_id, dn, min(seen) AS seen, arg_min(display, seen) AS display FROM nd WHERE dn <> '' GROUP BY run_id, dn),
led AS (SELECT run_id, list_reduce(list([dn] ORDER BY seen), lambda acc, x: CASE WHEN len(list_filter(acc, lambda l: {S.same('l', 'x[1]')})) > 0 THEN acc ELSE list_concat(acc, x) END) AS leaders FROM norms GROUP BY run_id),
asg AS (SELECT n.run_id, n.dn, list_filter(leaders, lambda l: {S.same('l', 'n.dn')})[1] AS cluster FROM norms n JOIN led USING (run_id)),
clus AS (SELECT nd.run_id, nd.name, nd.display, a.cluster, l.display AS business, l.seen AS cseen FROM nd JOIN asg a ON a.run_id = nd.run_id AND a.dn = nd.dn JOIN norms l ON l.run_id = nd.run_id AND l.dn = a.cluster
  UNION ALL SELECT run_id, name, display, lower(display), first_value(display) OVER w, first_value(seen) OVER w FROM nd WHERE dn = '' WINDOW w AS (PARTITION BY run_id, lower(display) ORDER BY seen)),
okn AS (SELECT run_id, count(*) AS total, count(*) FILTER (NOT failed) AS okc FROM answers GROUP BY run_id),
once AS (SELECT m.run_id, pi, it, cluster, min(i) AS i FROM m JOIN clus c ON c.run_id = m.run_id AND c.name = m.name GROUP BY ALL),
stats AS (SELECT run_id, cluster, count(*) AS k, count(DISTINCT pi) AS prompts, avg(i + 1) AS ap, count(*) FILTER (i % 3 = 0) AS pos, count(*) FILTER (i % 3 = 1) AS neu, count(*) FILTER (i % 3 = 2) AS neg FROM once GROUP BY ALL),
titles AS (SELECT DISTINCT run_id, cluster, business AS name, cseen, {S.norm('business')} AS bn FROM clus),
ranked AS (SELECT t.*, {_FIRST_PLACE.format(c='p.position', l="'maps'")} AS maps_rank, {_FIRST_PLACE.format(c='p.position', l="'local_pack'")} AS local_pack_rank FROM titles t),
biz AS (SELECT r.run_id, r.name, {_role('r.bn')} AS role, coalesce(k, 0) AS k, coalesce(k, 0)::DOUBLE / greatest(coalesce(okc, 0), 1) AS rate, ap, coalesce(prompts, 0) AS prompts, coalesce(pos, 0) AS pos, coalesce(neu, 0) AS neu, coalesce(neg, 0) AS neg,
  maps_rank, local_pack_rank, cseen, coalesce(maps_rank <= 10, false) OR local_pack_rank IS NOT NULL AS in_serp FROM ranked r LEFT JOIN stats s ON s.run_id = r.run_id AND s.cluster = r.cluster LEFT JOIN okn o ON o.run_id = r.run_id)"""

ORACLES = {
    "ai_visibility": f"""WITH {VISIBILITY} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY rate DESC, coalesce(maps_rank, 99), cseen)::INT AS rank, name, role, k AS ai_mentions, k AS ai_samples, round(rate, 6) AS ai_mention_rate, round(ap, 6) AS ai_avg_position, prompts AS ai_prompts,
        pos AS positive, neu AS neutral, neg AS negative, maps_rank, local_pack_rank, CASE WHEN k > 0 AND in_serp THEN 'both' WHEN k > 0 THEN 'ai_only' WHEN in_serp THEN 'serp_only' ELSE 'neither' END AS gap FROM biz QUALIFY rank <= 40""",
    "ai_visibility_summary": f"""WITH {VISIBILITY}, best AS (SELECT run_id, arg_min((name, k), (-rate, coalesce(maps_rank, 99), cseen)) AS b FROM biz WHERE role = 'brand' GROUP BY run_id), tot AS (SELECT run_id, sum(k)::BIGINT AS mt FROM stats GROUP BY run_id)
        SELECT o.run_id, total AS total_samples, okc AS successful_samples, round(coalesce(mt, 0)::DOUBLE / greatest(okc, 1), 6) AS avg_mentions, round(okc::DOUBLE / greatest(okc, 1), 6) AS avg_citations, b[1] AS brand,
        round(CASE WHEN coalesce(mt, 0) > 0 AND b IS NOT NULL THEN b[2]::DOUBLE / mt ELSE 0.0 END, 6) AS share_of_voice FROM okn o LEFT JOIN best USING (run_id) LEFT JOIN tot USING (run_id)""",
    "ai_visibility_prompts": f"""WITH {VISIBILITY}, shown AS (SELECT m.run_id, pi, it, display, min(i) AS i FROM m JOIN clus c ON c.run_id = m.run_id AND c.name = m.name GROUP BY ALL),
        cnt AS (SELECT run_id, pi, display, count(*) AS n, min((it, i)) AS seen FROM shown GROUP BY ALL), tops AS (SELECT run_id, pi, list(display ORDER BY n DESC, seen)[1:5] AS top FROM cnt GROUP BY ALL),
        a AS (SELECT run_id, pi, count(*) AS n FROM answers WHERE NOT failed GROUP BY ALL), h AS (SELECT run_id, pi, count(DISTINCT it) AS hits FROM shown WHERE {_role(S.norm('display'))} = 'brand' GROUP BY ALL)
        SELECT r.run_id, i::INT AS prompt_index, 'p' || i AS prompt, round(CASE WHEN coalesce(n, 0) > 0 THEN coalesce(hits, 0)::DOUBLE / n ELSE 0.0 END, 6) AS brand_rate, {S.join('top')} AS top
        FROM (SELECT run_id, unnest(range(4)) AS i FROM runs_) r LEFT JOIN a ON a.run_id = r.run_id AND a.pi = i LEFT JOIN h ON h.run_id = r.run_id AND h.pi = i LEFT JOIN tops t ON t.run_id = r.run_id AND t.pi = i""",
    "cited_domains": f"""WITH a AS (SELECT conv_id // 4 AS run_id, conv_id % 4 AS pi, turn AS it, lower(regexp_extract(text, '([A-Za-z]+)', 1)) || '.example.com' AS domain FROM conversations WHERE role = 'assistant' AND turn <> 5),
        g AS (SELECT run_id, domain, count(*) AS count, min((pi, it)) AS seen FROM a GROUP BY ALL)
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY count DESC, seen)::INT AS rank, domain, count, CASE WHEN domain LIKE '%ththre.example.com' THEN 'brand site' WHEN regexp_matches(domain, {S.q(V.CITATION_OTA_DOMAINS)}) THEN 'OTA'
        WHEN regexp_matches(domain, {S.q(V.CITATION_REVIEW_DOMAINS)}) THEN 'reviews / maps' WHEN regexp_matches(domain, {S.q(V.CITATION_FORUM_DOMAINS)}) THEN 'forum' ELSE 'editorial / other' END AS kind FROM g QUALIFY rank <= 25""",
    "topic_coverage_by_page": f"WITH {ORGANIC} SELECT serp_id, topic, {S.label('topic', L)} AS label, results, round(results::DOUBLE / n, 6) AS coverage FROM cov JOIN n USING (serp_id)",
    "covered_angles": f"WITH {ORGANIC} SELECT serp_id, row_number() OVER (PARTITION BY serp_id ORDER BY results DESC, seen)::INT AS rank, topic, results, n FROM cov JOIN n USING (serp_id) WHERE results::DOUBLE / n >= 0.2::DOUBLE QUALIFY rank <= 8",
    "asked_topics": f"WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {DEMAND} SELECT serp_id, topic, n_sources, array_to_string(sources, '|') AS sources FROM demand",
    "missing_topics": f"WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {DEMAND}, {GAPS} SELECT serp_id, row_number() OVER (PARTITION BY serp_id ORDER BY priority DESC, via)::INT AS rank, topic, lab AS label, reason, {S.topic_format('topic', L)} AS format, (topic IN (SELECT topic FROM facts))::INT AS brand_can_answer, priority FROM gaps QUALIFY rank <= 8",
    "result_formats": f"WITH {ORGANIC}, r AS (SELECT *, {S.domain('link')} AS domain, {S.fold('title')} AS f FROM organic), g AS (SELECT serp_id, {FORMAT} AS format, count(*) AS count, min(ord) AS seen FROM r GROUP BY ALL) SELECT serp_id, row_number() OVER (PARTITION BY serp_id ORDER BY count DESC, seen)::INT AS rank, format, count FROM g",
    "brand_positions": f"""WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {PLACES}, o AS (SELECT serp_id, min(ord) AS organic FROM organic WHERE ({S.domain('link')}) LIKE '%ththre.example.com' GROUP BY 1),
        l AS (SELECT serp_id, arg_min(position, ord) FILTER (list = 'local_pack') AS local_pack, arg_min(position, ord) FILTER (list = 'maps') AS maps FROM normed WHERE {_is_brand('tn')} GROUP BY 1)
        SELECT serp_id, organic, local_pack, maps FROM subj LEFT JOIN o USING (serp_id) LEFT JOIN l USING (serp_id)""",
    "page_features": f"""WITH {ORGANIC}, {SUBJECTS}, {TURNS} SELECT serp_id, array_to_string(list_filter([CASE WHEN serp_id % 3 = 0 THEN 'Featured snippet' END, CASE WHEN serp_id % 2 = 0 THEN 'AI Overview' END,
        CASE WHEN u THEN 'Local pack' END, CASE WHEN u THEN 'People Also Ask' END, CASE WHEN a THEN 'Discussions & forums' END, CASE WHEN s THEN 'Related searches' END], lambda x: x IS NOT NULL), '|') AS features
        FROM (SELECT serp_id, coalesce(bool_or(role = 'user'), false) AS u, coalesce(bool_or(role = 'assistant'), false) AS a, coalesce(bool_or(role = 'system'), false) AS s FROM subj LEFT JOIN turns USING (serp_id) GROUP BY serp_id)""",
    "rival_names": f"""WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {PLACES}, near AS (SELECT serp_id, title, tn, row_number() OVER (PARTITION BY serp_id ORDER BY CASE list WHEN 'local_pack' THEN 0 ELSE 1 END, ord) AS r FROM normed WHERE list <> 'tripadvisor' QUALIFY r <= 8),
        fold_ AS (SELECT serp_id, list_reduce(list_concat([['Sich Sich', 'Thatin', 'Orantion']], coalesce(list([title] ORDER BY r) FILTER (title IS NOT NULL AND NOT {_is_brand('tn')}), [])),
           lambda acc, x: CASE WHEN len(list_filter(acc, lambda l: {S.same(S.norm('l'), S.norm('x[1]'))})) > 0 THEN acc ELSE list_concat(acc, x) END) AS names FROM subj LEFT JOIN near USING (serp_id) GROUP BY serp_id)
        SELECT serp_id, array_to_string(names[1:6], '|') AS names FROM fold_""",
    "reviewed_places": f"""WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {PLACES}, firsts AS (SELECT serp_id, list_filter([arg_min(title, ord) FILTER (list = 'maps'), arg_min(title, ord) FILTER (list = 'tripadvisor')], lambda x: x IS NOT NULL) AS names FROM places GROUP BY serp_id),
        wanted AS (SELECT serp_id, 0 AS target, 'Orre Orre' AS name FROM subj UNION ALL SELECT serp_id, unnest(range(1, len(names) + 1))::INT, unnest(names) FROM firsts JOIN subj USING (serp_id)),
        hit AS (SELECT w.serp_id, target, name, list, arg_min(title, p.ord) AS title, min(p.ord) AS ord FROM (SELECT *, {S.norm('name')} AS wn FROM wanted WHERE name <> '') w JOIN normed p ON p.serp_id = w.serp_id AND list <> 'local_pack' AND {S.same('wn', 'tn')} GROUP BY ALL)
        SELECT serp_id, target, name, CASE list WHEN 'maps' THEN 'Google' ELSE 'Tripadvisor' END AS source, title, ord::VARCHAR AS ref,
          CASE list WHEN 'maps' THEN (SELECT count(DISTINCT text) FROM turns t WHERE t.serp_id = hit.serp_id AND role = 'assistant' AND array_to_string(string_split(t.text, ' ')[1:2], ' ') = hit.title) ELSE 0 END AS reviews FROM hit WHERE ord % 4 > 0""",
    "required_entity_names": f"WITH {ORGANIC}, {SUBJECTS}, {TURNS}, {entity_sql(_SERP_DOCS, ['Th', 'Ing', 'Tion'], ['orre orre', 'und'], 10, 'serp_id')} SELECT * FROM ents",
    "source_entities": f"WITH {entity_sql(_PROSE_DOCS, ['The Ing', 'Tion'], ['orre orre'], 15, 'source')} SELECT * FROM ents",
    "customer_questions": _questions(),
    "review_topics": _reviews(),
    "deduped_citations": """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS us, regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS ts, regexp_extract_all(html, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 2) AS mu, regexp_extract_all(html, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 1) AS mt FROM pages),
        e AS (SELECT page_id, unnest(range(len(a))) AS ord, unnest(a) AS url, unnest(b) AS t FROM (SELECT page_id, list_concat(mu, us) AS a, list_concat(mt, list_transform(ts, lambda t: regexp_replace(t, '<[^>]+>', '', 'g'))) AS b FROM l))
        SELECT page_id, url, min(ord)::INT AS ord, md5(arg_min(t, ord)) AS title_md5 FROM e GROUP BY page_id, url""",
}
