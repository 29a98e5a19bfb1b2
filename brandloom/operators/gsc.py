"""Search Console queries classified into opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.names import normalize_name
from brandloom.functions.regex import ascii_view, js_round, matches, trim_ws
from brandloom.functions.search import expected_ctr, keep_hits


def name_tokens(brands: DataFrame) -> DataFrame:
    """Normalised brand and competitor names of three or more characters."""
    alias_lists = F.transform("competitors", lambda c: F.concat(F.array(c["name"]), F.coalesce(c["aliases"], F.array().cast("array<string>"))))
    mine = F.concat(F.array("brand_name"), F.coalesce("brand_aliases", F.array().cast("array<string>")))

    def tokens(names: Column) -> Column:
        return F.filter(F.transform(names, normalize_name), lambda t: F.length(t) >= 3)

    return brands.select("project_id", tokens(mine).alias("brand_tokens"), tokens(F.flatten(F.coalesce(alias_lists, F.array().cast("array<array<string>>")))).alias("competitor_tokens"))


def classify_gsc(gsc: DataFrame, brands: DataFrame) -> DataFrame:
    """Adds pillar, signals, tail and score. A narrow projection after a join with
    the brand table; Catalyst broadcasts that table only while it is small."""
    rows = gsc.join(name_tokens(brands), "project_id")
    q = ascii_view(F.lower("query"))
    norm = normalize_name(F.col("query"))
    rows = rows.withColumns({"_q": q, "_n": norm}).withColumns(
        {
            "_rival": F.exists("competitor_tokens", lambda t: F.contains(F.col("_n"), t)),
            "_own": F.exists("brand_tokens", lambda t: F.contains(F.col("_n"), t)),
            "_compare": matches(F.col("_q"), V.GSC_COMPARISON),
            "_ask": matches(F.col("_q"), V.GSC_QUESTION),
            "_pos": F.coalesce("position", F.lit(100.0)),
            "_ctr": F.coalesce("ctr", F.when(F.col("impressions") != 0, F.col("clicks") / F.col("impressions")), F.lit(0.0)),
        }
    )
    pillar = F.when(F.col("_rival") | F.col("_compare"), "competitors").when(F.col("_own"), "company").otherwise("customers")
    pos, impressions = F.col("_pos"), F.col("impressions")
    signals = keep_hits(
        (F.col("_rival"), "competitor name"),
        (~F.col("_rival") & F.col("_compare"), "comparison intent"),
        (~F.col("_rival") & ~F.col("_compare") & F.col("_own"), "branded"),
        (F.col("_ask"), "question"),
        (matches(F.col("_q"), V.GSC_LOCAL), "local modifier"),
        ((pos >= 4) & (pos <= 20), "striking distance"),
        ((impressions >= 50) & (pos <= 10) & (F.col("_ctr") < expected_ctr(pos) * F.lit(0.6)), "low CTR for position"),
        ((impressions >= 20) & (pos > 20), "content gap (ranks beyond page 2)"),
    )
    potential = F.greatest(F.lit(0.0), impressions * (expected_ctr(F.least(pos, F.lit(3.0))) - F.col("_ctr")))
    score = js_round(potential + F.when(F.col("_ask"), 5).otherwise(0) + F.when(pillar == "competitors", 5).otherwise(0))
    n_words = F.size(F.split(trim_ws(F.col("query")), V.WS_CLASS + "+"))
    return rows.select(
        *gsc.columns, pillar.alias("pillar"), signals.alias("signals"),
        F.when(n_words >= 4, "long").otherwise("short").alias("tail"), score.alias("score"),
    )


def filter_opportunities(opps: DataFrame, pillar: str = "all", tail: str = "all", signal: str = "all", text: str = "") -> DataFrame:
    if pillar != "all":
        opps = opps.filter(F.col("pillar") == pillar)
    if tail != "all":
        opps = opps.filter(F.col("tail") == tail)
    if signal != "all":
        opps = opps.filter(F.array_contains("signals", signal))
    if text:
        opps = opps.filter(F.contains(F.lower("query"), F.lit(text.lower())))
    return opps


def distinct_signals(opps: DataFrame, keys: list[str]) -> DataFrame:
    each = opps.select(*keys, F.explode("signals").alias("signal")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("signal")).alias("signals"))


