"""Search Console, intent and content-plan queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.search import classify_intent, expected_ctr, localize, place_string, search_locale
from brandloom.operators.brands import brand_topics
from brandloom.operators.gsc import classify_gsc, distinct_signals, filter_opportunities
from brandloom.plans.content_plan import content_plan, opportunity_clusters, plan_summary
from brandloom.sources.gsc_csv import parse_number, parse_share
from brandloom.workload import data as D
from brandloom.workload import sqltext as S


def opportunities(spark, sf) -> DataFrame:
    return classify_gsc(D.gsc_queries(spark, sf), D.brands(spark))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("ord", "query", "page", "clicks", "impressions", F.round("position", 3).alias("position"), "pillar", F.array_join("signals", "|").alias("signals"), "tail", "score")


def gsc_opportunities(spark, sf):
    return _flat(opportunities(spark, sf))


def gsc_filtered(spark, sf):
    return _flat(filter_opportunities(opportunities(spark, sf), pillar="customers", tail="long", signal="question", text="RING"))


def gsc_signals(spark, sf):
    return distinct_signals(opportunities(spark, sf), ["pillar"]).select("pillar", F.array_join("signals", "|").alias("signals"))


def opportunity_themes(spark, sf):
    c = opportunity_clusters(opportunities(spark, sf), D.PART_WORDS)
    return c.select(
        "rank", "pillar", "theme", "cluster_score", "n_queries", F.col("lead.query").alias("lead"), F.array_join("signals", "|").alias("signals"),
        F.array_join("supporting", "|").alias("supporting"), F.array_join("questions", "|").alias("questions"),
    )


def content_plan_briefs(spark, sf):
    p = content_plan(opportunities(spark, sf), D.brands(spark), D.PART_WORDS)
    return p.select("rank", "title", "action", "pillar", "primary_query", "target_page", F.get("brand_facts_to_use", F.lit(0)).alias("fact"), "competitor_angle", "priority")


def content_plan_summary(spark, sf):
    o = opportunities(spark, sf)
    s = plan_summary(o, content_plan(o, D.brands(spark), D.PART_WORDS))
    return s.select("queries", "company", "customers", "competitors", "briefs", F.array_join("missing_brand_facts", "|").alias("missing"))


def approved_facts_by_topic(spark, sf):
    """First approved fact per topic, with the number of part names about the topic."""
    facts = brand_topics(D.brands(spark), D.PART_WORDS).filter(F.col("project_id") == "parts")
    names = D.table(spark, sf, "part").select(F.explode(D.PART_WORDS.topics_in(F.col("p_name"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("parts"))
    return names.join(facts, "topic", "left").select("topic", "parts", "fact")


def search_intents(spark, sf):
    g = D.gsc_queries(spark, sf)
    i = classify_intent(F.col("query"), F.array(F.lit("red widget")))
    g = g.withColumn("i", i)
    return g.select("ord", F.col("i.primary").alias("primary"), F.array_join("i.all", "|").alias("all_intents"), F.col("i.label").alias("label"))


def expected_clicks(spark, sf):
    """Clicks the curve predicts per order line position."""
    li = D.table(spark, sf, "lineitem").withColumn("pos", F.col("l_quantity") / 2 - 0.5)
    return li.groupBy("l_linenumber").agg(F.round(F.sum(expected_ctr(F.col("pos")) * 100), 4).alias("clicks"), F.count(F.lit(1)).alias("n"))


def localized_queries(spark, sf):
    c, n, r = (D.table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    query = F.concat(F.lit("hotels "), F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise("x"))
    return j.select("c_custkey", localize(query, F.col("n_name")).alias("query"), place_string(F.lit(""), F.col("n_name"), F.col("r_name")).alias("place"))


def search_locales(spark, sf):
    """Where each customer is searched from: canonical location, country, language, map position."""
    c, n, r = (D.table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    given = lambda by, value: F.when(k % by > 0, value)
    locale = search_locale(
        F.when(k % 5 == 0, F.concat("n_name", F.lit(" Province"))).when(k % 5 == 1, ""), given(3, F.col("c_mktsegment")), F.col("n_name"), F.col("r_name"),
        given(7, F.substring("n_name", 1, 2)), F.when(k % 4 == 0, "fr").when(k % 4 == 1, ""), given(11, F.col("c_acctbal") / 100), given(6, (k % 360 - 180) / 2),
    )
    return j.select("c_custkey", locale.alias("l")).select("c_custkey", "l.*")


def parsed_numbers(spark, sf):
    """Localised numbers back to values: thousands separators, percent signs, junk."""
    p = D.table(spark, sf, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat((F.col("p_partkey") % 90 + 1).cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(cents.cast("string"), F.lit(" %")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("-"), cents.cast("string"), F.lit(".5e1 units")))
        .otherwise("p_name")
    )
    return p.select("p_partkey", F.round(parse_number(text), 4).alias("number"), F.round(parse_share(text), 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    gsc_opportunities, gsc_filtered, gsc_signals, opportunity_themes, content_plan_briefs, content_plan_summary, approved_facts_by_topic, search_intents,
    expected_clicks, localized_queries, search_locales, parsed_numbers,
)}

_FLAT = "ord, query, page, clicks, impressions, round(position, 3) AS position, pillar, array_to_string(signals, '|') AS signals, tail, score"

_KEYED = f"""{S.opportunities()},
keyed AS (SELECT *, {S.topics(S.fold('query'), D.PART_WORDS)} AS ts, {S.content_words('query')} AS cw FROM opps),
themed AS (
  SELECT *, coalesce(list_filter(ts, lambda t: t <> 'colour')[1], ts[1]) AS topic,
         coalesce(list_filter(ts, lambda t: t <> 'colour')[1], ts[1], array_to_string(cw[1:2], ' ')) AS theme FROM keyed
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pillar, theme ORDER BY score DESC, ord) AS nth,
                  row_number() OVER (PARTITION BY pillar, theme, list_contains(signals, 'question') ORDER BY score DESC, ord) AS qth FROM themed),
clusters AS (
  SELECT pillar, theme, max(topic) AS topic, sum(score)::BIGINT AS cluster_score, count(*) AS n_queries, max(CASE WHEN nth = 1 THEN query END) AS lead,
         max(CASE WHEN nth = 1 THEN page END) AS lead_page, max(CASE WHEN nth = 1 THEN score END) AS lead_score, max(CASE WHEN nth = 1 THEN ord END) AS lead_ord,
         list_sort(list_distinct(flatten(list(signals)))) AS sigs,
         list(query ORDER BY nth) FILTER (nth BETWEEN 2 AND 6) AS supporting,
         list(query ORDER BY nth) FILTER (list_contains(signals, 'question') AND qth <= 4) AS questions
  FROM ranked GROUP BY pillar, theme
),
top AS (SELECT *, row_number() OVER (ORDER BY cluster_score DESC, lead_score DESC, lead_ord)::INT AS rank FROM clusters QUALIFY rank <= 8)"""

_FACTS = ["The new anvil is cold", "Small plates for every bolt", "Large economy rings", "Red widget promo gear", "Old gizmo standard", "Hot rods", "Blue bolts, medium gears"]
_FACT_ROWS = ", ".join(f"({i}, {S.q(f)})" for i, f in enumerate(_FACTS))
_OWN = ["red", "widget", "widgets", "hotel", "ring"]
_BRIEFS = f"""{_KEYED},
facts AS (SELECT i, f, {S.topics(S.fold('f'), D.PART_WORDS)} AS ft, {S.content_words('f')} AS fw FROM (VALUES {_FACT_ROWS}) v(i, f)),
topic_fact AS (SELECT t.topic, arg_min(f, i) AS fact FROM (SELECT unnest(ft) AS topic, i, f FROM facts) t GROUP BY t.topic),
lead_words AS (SELECT rank, list_filter({S.content_words('lead')}, lambda w: w NOT IN ({S.strs(_OWN)})) AS qw FROM top),
shared AS (SELECT rank, f, i, len(list_filter(fw, lambda w: list_contains(qw, w))) AS n, len(qw) AS nq FROM lead_words, facts),
best AS (SELECT rank, arg_min(f, -n * 1000 + i) AS f, max(n) AS n, max(nq) AS nq FROM shared GROUP BY rank),
briefs AS (
  SELECT top.*, {S.label('topic', D.PART_WORDS)} AS lab,
         coalesce((SELECT fact FROM topic_fact tf WHERE tf.topic = top.topic), CASE WHEN best.n >= 2 THEN best.f END,
                  CASE WHEN pillar = 'company' AND nq = 0 THEN {S.q(_FACTS[0])} END) AS fact
  FROM top JOIN best USING (rank)
),
finals AS (SELECT *, coalesce(fact, 'MISSING: ' || CASE WHEN lab IS NOT NULL THEN lower(lab) || ' details' ELSE 'facts that answer “' || lead || '”' END) AS shown FROM briefs)"""

# Title case: words after the first stay lower when small, else get a capital.
_TITLE = "CASE WHEN lab IS NOT NULL THEN lab || ': ' || lead ELSE lead END"
_CASED = (
    f"array_to_string(list_transform(string_split({_TITLE}, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({S.strs(V.TITLE_SMALL_WORDS)}) THEN lower(w) "
    "ELSE upper(w[1]) || w[2:] END), ' ')"
)


def _intents() -> str:
    hits = ["CASE WHEN contains(query, 'red widget') THEN 'Navigational' END"] + [f"CASE WHEN regexp_matches(query, {S.q(p)}) THEN {S.q(i)} END" for i, p in V.INTENT_PATTERNS]
    return f"""
WITH {S.GSC}, f AS (SELECT ord, query, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS found FROM gsc),
e AS (SELECT ord, query, CASE WHEN len(found) > 0 THEN found WHEN regexp_matches(query, {S.q(V.INTENT_FALLBACK_PATTERN)}) THEN ['Commercial investigation'] ELSE ['Informational'] END AS every FROM f),
p AS (SELECT *, CASE WHEN list_contains(every, 'Commercial investigation') AND list_contains(every, 'Transactional') AND NOT regexp_matches(query, {S.q(V.INTENT_BOOKING_PATTERN)})
            THEN 'Commercial investigation' ELSE every[1] END AS prim FROM e),
o AS (SELECT ord, prim, list_concat([prim], list_filter(every, lambda x: x <> prim)) AS oo FROM p)
SELECT ord, prim AS "primary", array_to_string(oo, '|') AS all_intents,
       CASE WHEN len(oo) > 1 THEN replace(oo[1], 'Commercial investigation', 'Commercial') || ' + ' || replace(oo[2], 'Commercial investigation', 'Commercial') ELSE prim END AS label FROM o"""


_NUMBER_TEXT = """CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 90 + 1)::VARCHAR || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')
  WHEN 1 THEN round(p_retailprice * 100)::BIGINT::VARCHAR || ' %' WHEN 2 THEN '-' || round(p_retailprice * 100)::BIGINT::VARCHAR || '.5e1 units' ELSE p_name END"""
_NUMBER = "coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(t, '[%,\\s]', '', 'g'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'), '') AS DOUBLE), 0.0::DOUBLE)"

ORACLES = {
    "gsc_opportunities": f"WITH {S.opportunities()} SELECT {_FLAT} FROM opps",
    "gsc_filtered": f"WITH {S.opportunities()} SELECT {_FLAT} FROM opps WHERE pillar = 'customers' AND tail = 'long' AND list_contains(signals, 'question') AND contains(lower(query), 'ring')",
    "gsc_signals": f"WITH {S.opportunities()} SELECT pillar, array_to_string(list_sort(list_distinct(flatten(list(signals)))), '|') AS signals FROM opps GROUP BY pillar",
    "opportunity_themes": f"WITH {_KEYED} SELECT rank, pillar, theme, cluster_score, n_queries, lead, {S.join('sigs')} AS signals, {S.join('supporting')} AS supporting, {S.join('questions')} AS questions FROM top",
    "content_plan_briefs": f"""WITH {_BRIEFS} SELECT rank, {_CASED} AS title,
        CASE WHEN list_contains(sigs, 'low CTR for position') THEN 'title_meta_rewrite' WHEN pillar = 'competitors' THEN 'comparison_page' WHEN theme = 'itinerary' THEN 'local_guide'
             WHEN list_contains(sigs, 'question') AND coalesce(lead_page, '') = '' THEN 'faq_block' WHEN coalesce(lead_page, '') <> '' AND list_contains(sigs, 'striking distance') THEN 'update_existing' ELSE 'new_page' END AS action,
        pillar, lead AS primary_query, coalesce(lead_page, 'new') AS target_page, shown AS fact,
        CASE WHEN pillar = 'competitors' THEN 'Compare honestly on the points where Red Widget has a documented edge.' ELSE '' END AS competitor_angle,
        CASE WHEN rank <= 2 OR cluster_score > 200 THEN 'high' WHEN rank <= 5 THEN 'medium' ELSE 'low' END AS priority FROM finals""",
    "content_plan_summary": f"""WITH {_BRIEFS}, miss AS (SELECT regexp_replace(shown, '^MISSING:\\s*', '') AS m, min(rank) AS r FROM finals WHERE starts_with(shown, 'MISSING') GROUP BY 1)
        SELECT count(*) AS queries, count(*) FILTER (pillar = 'company') AS company, count(*) FILTER (pillar = 'customers') AS customers, count(*) FILTER (pillar = 'competitors') AS competitors,
        (SELECT count(*) FROM finals) AS briefs, coalesce((SELECT string_agg(m, '|' ORDER BY r) FROM miss), '') AS missing FROM opps""",
    "approved_facts_by_topic": f"""WITH facts AS (SELECT i, f, {S.topics(S.fold('f'), D.PART_WORDS)} AS ft FROM (VALUES {_FACT_ROWS}) v(i, f)),
        tf AS (SELECT topic, arg_min(f, i) AS fact FROM (SELECT unnest(ft) AS topic, i, f FROM facts) GROUP BY topic),
        n AS (SELECT topic, count(*) AS parts FROM (SELECT unnest({S.topics(S.fold('p_name'), D.PART_WORDS)}) AS topic FROM part) GROUP BY topic)
        SELECT topic, parts, fact FROM n LEFT JOIN tf USING (topic)""",
    "search_intents": _intents(),
    "expected_clicks": f"""SELECT l_linenumber, round(sum(({S.ctr_curve('pos')}) * 100), 4) AS clicks, count(*) AS n FROM (SELECT l_linenumber, l_quantity / 2 - 0.5::DOUBLE AS pos FROM lineitem) GROUP BY 1""",
    "localized_queries": """SELECT c_custkey, CASE WHEN contains(lower(qy), lower(n_name)) THEN qy ELSE qy || ' ' || n_name END AS query, n_name || ', ' || r_name AS place
        FROM (SELECT *, 'hotels ' || CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE 'x' END AS qy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "search_locales": """WITH b AS (SELECT c_custkey AS k, * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        p AS (SELECT *, CASE WHEN k % 3 > 0 THEN c_mktsegment || ', ' ELSE '' END || n_name || ', ' || r_name AS place, c_acctbal / 100 AS lat, (k % 360 - 180) / 2 AS lng FROM b)
        SELECT c_custkey, place, CASE WHEN k % 5 = 0 THEN n_name || ' Province' ELSE place END AS location, CASE WHEN k % 7 > 0 THEN lower(n_name[1:2]) END AS gl, CASE WHEN k % 4 = 0 THEN 'fr' ELSE 'en' END AS hl,
          CASE WHEN k % 11 > 0 AND k % 6 > 0 THEN '@' || regexp_replace(lat::VARCHAR, '\\.0$', '') || ',' || regexp_replace(lng::VARCHAR, '\\.0$', '') || ',14z' END AS ll FROM p""",
    "parsed_numbers": f"""SELECT p_partkey, round({_NUMBER}, 4) AS number, round(CASE WHEN t = '' THEN NULL ELSE {_NUMBER} / CASE WHEN contains(t, '%') THEN 100 ELSE 1 END END, 6) AS share
        FROM (SELECT p_partkey, {_NUMBER_TEXT} AS t FROM part)""",
}
