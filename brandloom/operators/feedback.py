"""Feedback rules and the feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.operators.topics import top_rows


def active_rules(feedback: DataFrame, limit: int = 60) -> DataFrame:
    """Newest rules per project that every check must follow."""
    live = feedback.filter((F.col("status") != "archived") & (F.col("apply_as_rule") | F.col("kind").isin(V.RULE_KINDS)))
    return top_rows(live, ["project_id"], [F.desc("created_at"), "id"], limit)


def search_feedback(feedback: DataFrame, status: str = "all", kind: str = "all", text: str = "") -> DataFrame:
    if status != "all":
        feedback = feedback.filter(F.col("status") == status)
    if kind != "all":
        feedback = feedback.filter(F.col("kind") == kind)
    if text:
        hay = F.concat_ws(" ", F.col("content"), F.coalesce("context", F.lit("")), F.coalesce("author_name", F.lit("")))
        feedback = feedback.filter(F.contains(F.lower(hay), F.lit(text.lower())))
    return feedback


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Per project: entries per status, all entries and rules in force."""
    return feedback.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "applied", "archived")],
        F.count_if((F.col("status") != "archived") & (F.col("apply_as_rule") | (F.col("kind") != "feedback"))).alias("rules"),
    )


def with_draft_titles(feedback: DataFrame, drafts: DataFrame) -> DataFrame:
    return feedback.join(drafts.select("draft_id", F.col("title").alias("draft_title")), "draft_id", "left")


def high_severity(fact_checks) -> F.Column:
    """Number of high-severity entries in an array<struct<...,severity>> column."""
    return F.size(F.filter(fact_checks, lambda f: f["severity"] == "high"))
