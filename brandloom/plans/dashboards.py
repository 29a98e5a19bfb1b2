"""Roll-ups: knowledge score, workspace dashboard, project overview, research inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import js_round, trim_ws
from brandloom.functions.text import lines
from brandloom.operators.topics import top_rows


def _filled(c: str) -> Column:
    return trim_ws(F.coalesce(c, F.lit(""))) != ""


def _given(c: str) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def knowledge_items() -> list[tuple[str, Column, int, str]]:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = lambda c: F.coalesce(c, F.lit(0))
    # Labels, weights and hints of the completeness items.
    return [
        ("Brand summary", _filled("brand_summary"), 8, "One paragraph on who the brand is."),
        ("Approved facts (5+)", F.size(lines(F.col("brand_facts"))) >= 5, 16, "Rooms, distances, amenities, awards: one per line."),
        ("USPs", F.size(lines(F.col("usps"))) >= 2, 8, "What makes the brand the better choice."),
        ("Products & services", _filled("products"), 6, "Rooms, restaurants, spa, events…"),
        ("Restricted claims", F.size(lines(F.col("restricted_claims"))) >= 1, 8, "Claims the brand must never make."),
        ("Tone of voice", _filled("tone_of_voice"), 8, "How the brand sounds."),
        ("Words to avoid / use", _filled("words_to_avoid") | _filled("words_to_use"), 5, "Vocabulary rules."),
        ("CTA preference", _filled("cta_preference"), 4, "e.g. “Check availability”."),
        ("Target audiences", _filled("target_customers"), 8, "Segments and what they care about."),
        ("Competitors listed", size("competitors") >= 2, 7, "At least two, with exact names."),
        ("Location set", _given("city") & _given("country_code"), 5, "City and country code for local search."),
        ("Site pages for internal links", size("site_pages") >= 3, 5, "Rooms, dining, offers, contact…"),
        ("Brand documents", count("documents") > 0, 6, "Guidelines, fact sheets, approved articles."),
        ("Feedback rules", count("rules") > 0, 3, "Lessons from client feedback."),
        ("Market research", count("research") > 0, 3, "At least one Local Research run."),
    ]


def _counts(children: dict[str, DataFrame]) -> DataFrame:
    """Rows of each child per project, by one aggregation: a task holds no sort for each child."""
    rows = None
    for name, df in children.items():
        one = df.select("project_id", F.lit(name).alias("_child"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("project_id").agg(*[F.count_if(F.col("_child") == name).alias(name) for name in children])


def knowledge_score(brands: DataFrame, documents: DataFrame, rules: DataFrame, runs: DataFrame) -> DataFrame:
    """Completeness of each brand's knowledge base, 0 to 100, with what is missing."""
    b = brands.join(_counts({"documents": documents, "rules": rules, "research": runs}), "project_id", "left")
    items = knowledge_items()
    total = sum(w for _, _, w, _ in items)
    parts = F.array(
        *[F.struct(F.lit(lab).alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(w).alias("weight"), F.lit(h).alias("hint")) for lab, ok, w, h in items]
    )
    got = F.aggregate(F.filter("items", lambda i: i["ok"]), F.lit(0), lambda s, i: s + i["weight"])
    return b.withColumn("items", parts).select(
        "project_id", js_round(got / total * 100).alias("score"), "items",
        F.transform(F.filter("items", lambda i: ~i["ok"]), lambda i: i["label"]).alias("missing"),
    )


def workspace_dashboard(projects: DataFrame, drafts: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """One row: projects, drafts, drafts in flight, and runs in the month of ``as_of``."""
    d = drafts.agg(F.count(F.lit(1)).alias("drafts"), F.count_if(F.col("status").isin(V.IN_FLIGHT)).alias("in_flight"))
    r = runs.agg(F.count_if(F.col("created_at") >= F.date_trunc("month", as_of)).alias("runs_this_month"))
    p = projects.agg(F.count(F.lit(1)).alias("projects"))
    one = F.lit(1).alias("k")
    return p.select("*", one).join(d.select("*", one), "k").join(r.select("*", one), "k").drop("k")


def pipeline_counts(drafts: DataFrame) -> DataFrame:
    """Drafts per pipeline stage, stages without drafts included."""
    stages = drafts.sparkSession.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(V.PIPELINE)], "stage_ord int, status string, label string")
    n = drafts.groupBy("status").agg(F.count(F.lit(1)).alias("drafts"))
    return stages.join(n, "status", "left").select("stage_ord", "status", "label", F.coalesce("drafts", F.lit(0)).alias("drafts"))


def project_cards(projects: DataFrame, drafts: DataFrame) -> DataFrame:
    n = drafts.groupBy("project_id").agg(F.count(F.lit(1)).alias("pieces"))
    return projects.join(n, "project_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))


def draft_averages(drafts: DataFrame) -> DataFrame:
    """Drafts and their average score per project."""
    return drafts.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_drafts"), js_round(F.avg("overall")).alias("avg_score"))


def project_overview(
    brands: DataFrame, documents: DataFrame, drafts: DataFrame, feedback: DataFrame, runs: DataFrame, briefs: DataFrame, gsc: DataFrame, latest_runs: int = 6
) -> DataFrame:
    """Counts, average draft score, latest visibility rate and the eight workflow
    steps per project. ``drafts`` carries overall; ``runs`` kind, status, created_at
    and brand_rate (of visibility runs)."""
    recent = top_rows(runs, ["project_id"], [F.desc("created_at"), "run_id"], latest_runs)
    rules = feedback.filter(F.col("apply_as_rule"))
    done = F.coalesce((F.col("kind") == "ai_visibility") & (F.col("status") == "done"), F.lit(False))
    per_run = recent.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.bool_or(F.col("kind") == "local_context").alias("has_local"),
        F.min_by("brand_rate", F.when(done, F.col("rank"))).alias("visibility_rate"), F.bool_or(done).alias("has_visibility"),
    )
    per_draft = draft_averages(drafts)
    ks = knowledge_score(brands, documents, rules, recent).select("project_id", F.col("score").alias("knowledge"))
    out = brands.select("project_id", F.coalesce(F.size("competitors"), F.lit(0)).alias("n_competitors"))
    out = out.join(_counts({"n_gsc": gsc, "n_briefs": briefs, "n_rules": rules, "n_documents": documents}), "project_id", "left")
    out = out.join(per_run, "project_id", "left").join(per_draft, "project_id", "left").join(ks, "project_id")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("n_gsc", "n_briefs", "n_rules", "n_documents", "n_runs", "n_drafts")})
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_local", "has_visibility")})
    steps = [
        ("Brand understanding", F.col("knowledge") >= 60), ("Customer understanding", F.col("has_local")),
        ("Competitor understanding", F.col("n_competitors") >= 2), ("Search intelligence", F.col("n_gsc") > 0),
        ("Content strategy", F.col("n_briefs") > 0), ("Content creation", F.col("n_drafts") > 0),
        ("Quality validation", F.coalesce(F.col("avg_score") >= 70, F.lit(False))), ("Feedback learning", F.col("n_rules") > 0),
    ]
    return out.withColumn("steps", F.array(*[F.struct(F.lit(lab).alias("label"), ok.alias("done")) for lab, ok in steps]))


LOCAL_SUMMARY = "struct<customer_questions:array<struct<question:string>>,content_angles:array<string>>"
VISIBILITY_SUMMARY = (
    "struct<brand:struct<ai_mention_rate:double>,businesses:array<struct<name:string>>,citation_domains:array<struct<domain:string>>>"
)


def local_summary(summary: Column) -> Column:
    """Typed market-research summary from JSON in either of its two layouts."""
    nested = F.from_json(summary, f"struct<ai:{LOCAL_SUMMARY}>")["ai"]
    flat = F.from_json(summary, LOCAL_SUMMARY)
    return F.coalesce(nested, F.when(flat["customer_questions"].isNotNull(), flat))


def research_inputs(runs: DataFrame, latest: int = 6, questions: int = 40, angles: int = 15, leaders: int = 5, domains: int = 8) -> DataFrame:
    """Per project: what the latest finished runs add to a content plan.
    ``runs``: project_id, run_id, kind, status, summary (JSON), created_at."""
    recent = top_rows(runs.filter(F.col("status") == "done"), ["project_id"], [F.desc("created_at"), "run_id"], latest)
    vis = F.from_json("summary", VISIBILITY_SUMMARY)
    parsed = recent.select(
        "project_id", "rank",
        F.when(F.col("kind") == "local_context", local_summary(F.col("summary"))).alias("local"),
        F.when(
            F.col("kind") == "ai_visibility",
            F.struct(
                F.coalesce(vis["brand"]["ai_mention_rate"], F.lit(0.0)).alias("brand_rate"),
                F.slice(F.transform(vis["businesses"], lambda b: b["name"]), 1, leaders).alias("leaders"),
                F.slice(F.transform(vis["citation_domains"], lambda d: d["domain"]), 1, domains).alias("cited_domains"),
            ),
        ).alias("visibility"),
    )
    # Six rows per project at most, so the lists stay small.
    packed = parsed.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rank", "local", "visibility"))).alias("rs"))
    asked = F.flatten(F.transform(F.filter("rs", lambda r: r["local"].isNotNull()), lambda r: F.coalesce(F.transform(r["local"]["customer_questions"], lambda q: q["question"]), F.array().cast("array<string>"))))
    said = F.flatten(F.transform(F.filter("rs", lambda r: r["local"].isNotNull()), lambda r: F.coalesce(r["local"]["content_angles"], F.array().cast("array<string>"))))
    return packed.select(
        "project_id", F.slice(asked, 1, questions).alias("customer_questions"), F.slice(said, 1, angles).alias("content_angles"),
        F.transform(F.filter("rs", lambda r: r["visibility"].isNotNull()), lambda r: r["visibility"]).alias("ai_visibility"),
    )


def linked_runs(drafts: DataFrame, runs: DataFrame) -> DataFrame:
    """Finished research runs a draft refers to, each once. ``drafts``: draft_id, research_run_ids."""
    refs = drafts.select("draft_id", F.explode(F.array_distinct("research_run_ids")).alias("run_id"))
    return refs.join(runs.filter(F.col("status") == "done"), "run_id")


def latest_per_project(df: DataFrame, *order: str) -> DataFrame:
    """The last row of each project by ``order`` (most significant column first; end with a key
    to settle ties). Combined in the tasks, so a hot project costs one row for each of them."""
    cols = [c for c in df.columns if c != "project_id"]
    by = F.struct(*(order or ("created_at",)))
    return df.groupBy("project_id").agg(F.max_by(F.struct(*cols), by).alias("r")).select("project_id", "r.*")
