"""Dashboards, feedback and key-based table maintenance queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.operators import feedback as FB
from brandloom.operators import keyed as K
from brandloom.plans import dashboards as DB
from brandloom.workload import data as D


def feedback(spark, sf):
    """Events as feedback entries of their user's project."""
    e = D.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_id").alias("draft_id"),
        F.when(F.col("event_type") == "purchase", "rule").when(F.col("event_type") == "signup", "fact_correction").otherwise("feedback").alias("kind"),
        F.when(F.col("event_type") == "error", "archived").when(F.col("value") > 10, "applied").otherwise("open").alias("status"), (F.col("value") > 20).alias("apply_as_rule"),
        F.col("props").alias("content"), F.col("event_type").alias("context"), F.lit(None).cast("string").alias("author_name"), F.col("ts").alias("created_at"),
    )


def drafts(spark, sf):
    """Orders as content drafts of their customer's project."""
    stage = F.substring("o_orderpriority", 1, 1)
    status = F.when(stage == "1", "planned").when(stage == "2", "processing").when(stage == "3", "draft").when(stage == "4", "review").otherwise(F.when(F.col("o_orderstatus") == "F", "published").otherwise("complete"))
    return D.table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("draft_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), (F.floor(F.col("o_totalprice")) % 100).cast("int").alias("overall"))


def projects(spark, sf):
    return D.table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))


def runs(spark, sf):
    return D.table(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"))


def rules_in_force(spark, sf):
    return FB.active_rules(feedback(spark, sf), 60).select("project_id", "rank", "id", "kind")


def feedback_status(spark, sf):
    return FB.feedback_counts(feedback(spark, sf))


def feedback_search(spark, sf):
    return FB.search_feedback(feedback(spark, sf), status="open", kind="rule", text='"K": 7').select("id", "project_id", "content")


def feedback_drafts(spark, sf):
    """Feedback with the title of its draft; links to missing drafts are cleared."""
    d = drafts(spark, sf).select("draft_id", F.concat(F.lit("Draft "), F.col("draft_id").cast("string")).alias("title"))
    f = K.clear_missing_parent(feedback(spark, sf), d, "draft_id", "draft_id")
    return FB.with_draft_titles(f, d).select("id", "draft_id", "draft_title")


def pipeline_stages(spark, sf):
    return DB.pipeline_counts(drafts(spark, sf)).select("stage_ord", "status", "label", "drafts")


def workspace_totals(spark, sf):
    return DB.workspace_dashboard(projects(spark, sf), drafts(spark, sf), runs(spark, sf), F.lit("2024-01-20").cast("timestamp"))


def project_pieces(spark, sf):
    return DB.project_cards(projects(spark, sf), drafts(spark, sf))


def average_scores(spark, sf):
    return DB.draft_averages(drafts(spark, sf)).withColumnRenamed("n_drafts", "drafts")


def profiles(spark, sf):
    """Customers as brand profiles of different completeness."""
    k = F.col("c_custkey")
    some = lambda by, value: F.when(k % by > 0, value)
    filler = lambda by: F.array_join(F.array_repeat(F.lit("- A line"), (k % by).cast("int")), "\n")
    rival = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("Rival "), i.cast("string")))
    page = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit("/page/"), i.cast("string")))
    return D.table(spark, sf, "customer").select(
        k.alias("project_id"), some(2, F.col("c_name")).alias("brand_summary"), filler(8).alias("brand_facts"), filler(3).alias("usps"), some(3, F.lit(" ")).alias("products"),
        filler(2).alias("restricted_claims"), some(5, F.col("c_mktsegment")).alias("tone_of_voice"), some(4, F.lit("x")).alias("words_to_avoid"), F.lit("").alias("words_to_use"),
        some(6, F.lit("Book")).alias("cta_preference"), some(7, F.col("c_mktsegment")).alias("target_customers"), F.when(k % 9 > 0, rival).alias("competitors"),
        some(10, F.lit("City")).alias("city"), F.when(k % 11 > 0, "vn").otherwise("").alias("country_code"), F.when(k % 13 > 0, page).alias("site_pages"),
    )


def research_runs(spark, sf):
    """Events as research runs with a JSON summary; local ones in either of two layouts."""
    e = D.table(spark, sf, "events")
    i = F.col("event_id")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "ai_visibility").when(F.col("event_type") == "error", "other").otherwise("local_context")
    numbered = lambda prefix, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda x: F.concat(F.lit(prefix), i.cast("string"), F.lit("."), x.cast("string")))
    local = F.struct(
        F.transform(numbered("q", i % 9 + 1), lambda q: F.struct(q.alias("question"))).alias("customer_questions"), F.when(i % 5 > 0, numbered("a", i % 4 + 1)).alias("content_angles"),
    )
    rate = F.when(F.col("event_type") == "purchase", i % 8 / 8)
    visibility = F.struct(
        F.struct(rate.alias("ai_mention_rate")).alias("brand"), F.transform(numbered("b", i % 7 + 1), lambda b: F.struct(b.alias("name"))).alias("businesses"),
        F.transform(numbered("d", i % 10 + 1), lambda d: F.struct(d.alias("domain"))).alias("citation_domains"),
    )
    summary = F.when(kind == "ai_visibility", F.to_json(visibility)).when(kind == "local_context", F.when(i % 2 == 0, F.to_json(F.struct(local.alias("ai")))).otherwise(F.to_json(local)))
    return e.select(
        F.col("user_id").alias("project_id"), i.alias("run_id"), kind.alias("kind"), F.when(i % 6 > 0, "done").otherwise("running").alias("status"), summary.alias("summary"),
        F.col("ts").alias("created_at"), F.when(kind == "ai_visibility", F.coalesce(rate, F.lit(0.0))).alias("brand_rate"),
    )


def knowledge_scores(spark, sf):
    """Completeness of each brand's profile, and what is missing."""
    rules = feedback(spark, sf).filter("apply_as_rule")
    s = DB.knowledge_score(profiles(spark, sf), drafts(spark, sf), rules, research_runs(spark, sf))
    return s.select("project_id", "score", F.array_join("missing", "|").alias("missing"))


def project_steps(spark, sf):
    """Counts, average score, visibility rate and finished workflow steps of each project."""
    d = drafts(spark, sf)
    parts = {"documents": d.filter("status = 'published'"), "drafts": d.filter("status <> 'planned'"), "briefs": d.filter("status = 'planned'")}
    gsc = D.table(spark, sf, "orders").filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("project_id"))
    o = DB.project_overview(profiles(spark, sf), parts["documents"], parts["drafts"], feedback(spark, sf), research_runs(spark, sf), parts["briefs"], gsc)
    done = F.array_join(F.transform(F.filter("steps", lambda s: s["done"]), lambda s: s["label"]), "|")
    return o.select("project_id", "n_gsc", "n_briefs", "n_rules", "n_documents", "n_drafts", "n_runs", "avg_score", "visibility_rate", "knowledge", done.alias("steps_done"))


def plan_research(spark, sf):
    """What the last finished research runs of each project bring into its content plan."""
    shown = lambda v: F.concat_ws(" ", v["brand_rate"].cast("string"), F.array_join(v["leaders"], ","), F.array_join(v["cited_domains"], ","))
    r = DB.research_inputs(research_runs(spark, sf))
    return r.select("project_id", F.array_join("customer_questions", "|").alias("questions"), F.array_join("content_angles", "|").alias("angles"), F.array_join(F.transform("ai_visibility", shown), "|").alias("visibility"))


def draft_research(spark, sf):
    """Finished research runs that each draft refers to."""
    k = F.col("o_orderkey")
    refs = D.table(spark, sf, "orders").select(k.alias("draft_id"), F.array(k, F.col("o_custkey"), F.floor(k / 2), F.lit(-1).cast("long"), k).alias("research_run_ids"))
    return DB.linked_runs(refs, research_runs(spark, sf).select("run_id", "kind", "status")).select("draft_id", "run_id", "kind")


def latest_visibility_runs(spark, sf):
    """The last visibility run of each project."""
    r = research_runs(spark, sf).filter("kind = 'ai_visibility'")
    return DB.latest_per_project(r, "created_at", "run_id").select("project_id", "run_id", "status", "brand_rate")


def latest_events(spark, sf):
    """Two batches of events merged: the newest row per user and type stays."""
    e = D.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    old, new = e.filter(F.col("ts") < "2024-01-16"), e.filter(F.col("ts") >= "2024-01-10")
    return K.upsert_latest(old, new, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


def cascaded_delete(spark, sf):
    """Rows and optional references left per table, after removing the projects with a negative
    balance, the runs that ended in an error and the documents labelled as poor."""
    c, e, d = D.table(spark, sf, "customer"), D.table(spark, sf, "events"), D.table(spark, sf, "documents")
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_index", "content")
    tables = {
        "projects": projects(spark, sf), "content_drafts": drafts(spark, sf), "feedback_logs": feedback(spark, sf), "research_runs": runs(spark, sf),
        "visibility_samples": D.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), "turn"),
        "documents": d.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("project_id")),
        "document_chunks": d.select(F.col("doc_id").alias("document_id"), lines),
    }
    gone = {
        "projects": c.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("project_id")),
        "research_runs": e.filter(F.col("event_type") == "error").select(F.col("event_id").alias("run_id")),
        "documents": D.table(spark, sf, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("document_id")),
    }
    left = K.cascade_delete(tables, gone)
    linked = lambda name: F.count("draft_id") if name == "feedback_logs" else F.lit(None).cast("long")
    parts = [df.agg(F.count(F.lit(1)).alias("n"), linked(name).alias("linked")).select(F.lit(name).alias("table_name"), "n", "linked") for name, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


def orphaned_feedback(spark, sf):
    """Feedback of projects that are gone (negative balance)."""
    alive = D.table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("project_id"))
    return K.orphans(feedback(spark, sf), alive, "project_id", "project_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def filtered_orders(spark, sf):
    o = D.table(spark, sf, "orders")
    tests = [K.neq("o_orderstatus", "F"), K.any_eq([("o_orderpriority", "1-URGENT"), ("o_custkey", 7)]), K.one_of("o_orderstatus", ["O", "P"])]
    return K.read_table(o, tests, [("o_totalprice", False)], 50, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


QUERIES = {f.__name__: f for f in (
    rules_in_force, feedback_status, feedback_search, feedback_drafts, pipeline_stages, workspace_totals, project_pieces, average_scores, knowledge_scores, project_steps, plan_research,
    draft_research, latest_visibility_runs, latest_events, cascaded_delete,
    orphaned_feedback, filtered_orders,
)}

_FB = """fb AS (SELECT event_id AS id, user_id AS project_id, CASE event_type WHEN 'purchase' THEN 'rule' WHEN 'signup' THEN 'fact_correction' ELSE 'feedback' END AS kind,
  CASE WHEN event_type = 'error' THEN 'archived' WHEN value > 10 THEN 'applied' ELSE 'open' END AS status, value > 20 AS apply, props AS content, event_type AS context, ts FROM events)"""
_DR = """dr AS (SELECT o_custkey AS project_id, o_orderkey AS draft_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'planned' WHEN '2' THEN 'processing' WHEN '3' THEN 'draft' WHEN '4' THEN 'review' ELSE CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'complete' END END AS status,
  (floor(o_totalprice)::BIGINT % 100)::INT AS overall FROM orders)"""
_RUNS = """rr AS (SELECT user_id AS project_id, event_id AS run_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'ai_visibility' WHEN event_type = 'error' THEN 'other' ELSE 'local_context' END AS kind,
  event_id % 6 > 0 AS done, ts, CASE WHEN event_type = 'purchase' THEN event_id % 8 / 8 WHEN event_type = 'signup' THEN 0.0::DOUBLE END AS rate FROM events)"""
_KNOWN = {  # item of the profile: (holds, weight)
    "Brand summary": ("k % 2 > 0", 8), "Approved facts (5+)": ("k % 8 >= 5", 16), "USPs": ("k % 3 >= 2", 8), "Products & services": ("false", 6), "Restricted claims": ("k % 2 >= 1", 8),
    "Tone of voice": ("k % 5 > 0", 8), "Words to avoid / use": ("k % 4 > 0", 5), "CTA preference": ("k % 6 > 0", 4), "Target audiences": ("k % 7 > 0", 8), "Competitors listed": ("k % 9 > 0 AND k % 4 >= 1", 7),
    "Location set": ("k % 10 > 0 AND k % 11 > 0", 5), "Site pages for internal links": ("k % 13 > 0 AND k % 5 >= 2", 5), "Brand documents": ("n_docs > 0", 6), "Feedback rules": ("n_rules > 0", 3), "Market research": ("n_runs > 0", 3),
}
_SCORE = f"floor(({' + '.join(f'CASE WHEN {c} THEN {w} ELSE 0 END' for c, w in _KNOWN.values())}) / {sum(w for _, w in _KNOWN.values())} * 100 + 0.5)::BIGINT"


def _known(docs: str, runs: str) -> str:
    return f"""kn AS (SELECT c_custkey AS k, (SELECT count(*) FROM dr WHERE project_id = c_custkey {docs}) AS n_docs, (SELECT count(*) FROM fb WHERE project_id = c_custkey AND apply) AS n_rules, (SELECT {runs} FROM rr WHERE project_id = c_custkey) AS n_runs FROM customer)"""


_STAGES = "(VALUES (0, 'planned', 'Planned'), (1, 'processing', 'In Progress'), (2, 'draft', 'Draft'), (3, 'review', 'Review'), (4, 'complete', 'Complete'), (5, 'published', 'Published')) s(stage_ord, status, label)"

ORACLES = {
    "rules_in_force": f"WITH {_FB} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, id)::INT AS rank, id, kind FROM fb WHERE status <> 'archived' AND (apply OR kind IN ('rule', 'fact_correction')) QUALIFY rank <= 60",
    "feedback_status": f"WITH {_FB} SELECT project_id, count(*) AS total, count(*) FILTER (status = 'open') AS \"open\", count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (status <> 'archived' AND (apply OR kind <> 'feedback')) AS rules FROM fb GROUP BY project_id",
    "feedback_search": f"WITH {_FB} SELECT id, project_id, content FROM fb WHERE status = 'open' AND kind = 'rule' AND contains(lower(content || ' ' || context), '\"k\": 7')",
    "feedback_drafts": "SELECT event_id AS id, o_orderkey AS draft_id, 'Draft ' || o_orderkey AS draft_title FROM events LEFT JOIN orders ON o_orderkey = event_id",
    "pipeline_stages": f"WITH {_DR} SELECT stage_ord, s.status, label, count(draft_id) AS drafts FROM {_STAGES} LEFT JOIN dr ON dr.status = s.status GROUP BY ALL",
    "workspace_totals": f"WITH {_DR} SELECT (SELECT count(*) FROM customer) AS projects, count(*) AS drafts, count(*) FILTER (status IN ('planned', 'processing', 'draft', 'review')) AS in_flight, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-01') AS runs_this_month FROM dr",
    "project_pieces": "SELECT c_custkey AS project_id, c_name AS name, count(o_orderkey) AS pieces FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "average_scores": f"WITH {_DR} SELECT project_id, floor(avg(overall) + 0.5)::BIGINT AS avg_score, count(*) AS drafts FROM dr GROUP BY project_id",
    "knowledge_scores": f"""WITH {_FB}, {_DR}, {_RUNS}, {_known('', 'count(*)')} SELECT k AS project_id, {_SCORE} AS score,
        concat_ws('|', {', '.join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, (c, _) in _KNOWN.items())}) AS missing FROM kn""",
    "project_steps": f"""WITH {_FB}, {_DR}, {_RUNS}, {_known("AND status = 'published'", 'least(count(*), 6)')},
        recent AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, run_id) <= 6),
        o AS (SELECT kn.*, {_SCORE} AS knowledge, (SELECT count(*) FROM orders WHERE o_custkey = k AND o_custkey % 3 = 0) AS n_gsc, (SELECT count(*) FROM dr WHERE project_id = k AND status = 'planned') AS n_briefs,
          (SELECT count(*) FROM dr WHERE project_id = k AND status <> 'planned') AS n_drafts, (SELECT floor(avg(overall) + 0.5)::BIGINT FROM dr WHERE project_id = k AND status <> 'planned') AS avg_score,
          (SELECT arg_max(rate, ts) FROM recent r WHERE r.project_id = k AND kind = 'ai_visibility' AND done) AS visibility_rate, EXISTS (FROM recent r WHERE r.project_id = k AND kind = 'local_context') AS has_local FROM kn)
        SELECT k AS project_id, n_gsc, n_briefs, n_rules, n_docs AS n_documents, n_drafts, n_runs, avg_score, visibility_rate, knowledge, concat_ws('|', CASE WHEN knowledge >= 60 THEN 'Brand understanding' END,
          CASE WHEN has_local THEN 'Customer understanding' END, CASE WHEN k % 9 > 0 AND k % 4 >= 1 THEN 'Competitor understanding' END, CASE WHEN n_gsc > 0 THEN 'Search intelligence' END, CASE WHEN n_briefs > 0 THEN 'Content strategy' END,
          CASE WHEN n_drafts > 0 THEN 'Content creation' END, CASE WHEN avg_score >= 70 THEN 'Quality validation' END, CASE WHEN n_rules > 0 THEN 'Feedback learning' END) AS steps_done FROM o""",
    "plan_research": f"""WITH {_RUNS}, recent AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, run_id) AS r FROM rr WHERE done QUALIFY r <= 6),
        lists AS (SELECT project_id, flatten(list(list_transform(range(1, run_id % 9 + 2), lambda x: 'q' || run_id || '.' || x) ORDER BY r) FILTER (kind = 'local_context')) AS qs,
          flatten(list(list_transform(range(1, CASE WHEN run_id % 5 > 0 THEN run_id % 4 + 2 ELSE 1 END), lambda x: 'a' || run_id || '.' || x) ORDER BY r) FILTER (kind = 'local_context')) AS ans,
          list(rate::VARCHAR || ' ' || array_to_string(list_transform(range(1, least(run_id % 7 + 2, 6)), lambda x: 'b' || run_id || '.' || x), ',') || ' ' || array_to_string(list_transform(range(1, least(run_id % 10 + 2, 9)), lambda x: 'd' || run_id || '.' || x), ',') ORDER BY r) FILTER (kind = 'ai_visibility') AS vs
          FROM recent GROUP BY project_id)
        SELECT project_id, coalesce(array_to_string(qs[1:40], '|'), '') AS questions, coalesce(array_to_string(ans[1:15], '|'), '') AS angles, coalesce(array_to_string(vs, '|'), '') AS visibility FROM lists""",
    "draft_research": f"WITH {_RUNS}, refs AS (SELECT DISTINCT o_orderkey AS draft_id, unnest([o_orderkey, o_custkey, o_orderkey // 2]) AS run_id FROM orders) SELECT draft_id, run_id, kind FROM refs JOIN rr USING (run_id) WHERE done",
    "latest_visibility_runs": f"WITH {_RUNS} SELECT project_id, run_id, CASE WHEN done THEN 'done' ELSE 'running' END AS status, rate AS brand_rate FROM rr WHERE kind = 'ai_visibility' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, run_id DESC) = 1",
    "latest_events": "SELECT user_id, event_type, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "cascaded_delete": """WITH gp AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0), gd AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (FROM gp)),
        gr AS (SELECT event_id AS k FROM events WHERE event_type = 'error' OR user_id IN (FROM gp)), left_docs AS (SELECT * FROM documents d WHERE NOT EXISTS (FROM gp WHERE k = doc_id) AND NOT EXISTS (FROM labels l WHERE l.quality = 0 AND l.doc_id = d.doc_id))
        SELECT 'projects' AS table_name, count(*) AS n, NULL::BIGINT AS linked FROM customer WHERE c_custkey NOT IN (FROM gp)
        UNION ALL SELECT 'content_drafts', count(*), NULL FROM orders WHERE o_custkey NOT IN (FROM gp) UNION ALL SELECT 'feedback_logs', count(*), count(*) FILTER (event_id NOT IN (FROM gd)) FROM events WHERE user_id NOT IN (FROM gp)
        UNION ALL SELECT 'research_runs', count(*), NULL FROM events WHERE event_id NOT IN (FROM gr) UNION ALL SELECT 'visibility_samples', count(*), NULL FROM conversations WHERE conv_id NOT IN (FROM gr)
        UNION ALL SELECT 'documents', count(*), NULL FROM left_docs UNION ALL SELECT 'document_chunks', sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT, NULL FROM left_docs""",
    "orphaned_feedback": f"WITH {_FB} SELECT kind, count(*) AS n FROM fb WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY kind",
    "filtered_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus <> 'F' AND (o_orderpriority = '1-URGENT' OR o_custkey = 7) AND o_orderstatus IN ('O', 'P') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
}
