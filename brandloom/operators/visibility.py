"""Who AI answers recommend, against Maps and local-pack ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.names import any_same, first_same, normalize_name, proper_prefixes
from brandloom.functions.search import domain_kind
from brandloom.operators.brands import brand_profile
from brandloom.operators.leaders import LOCAL_EDGES, leader_clusters
from brandloom.operators.names import first_match
from brandloom.operators.topics import top_rows
from brandloom.session import cut_lineage

MENTION = "struct<name:string,canonical:string,position:int,sentiment:string,context:string>"
#: Places of the Maps list that are shown beside the answers.
TOP_PLACES = 10
CITATION = "struct<url:string,title:string,domain:string>"


def successful(samples: DataFrame) -> DataFrame:
    return samples.filter((F.coalesce("error", F.lit("")) == "") & F.col("mentions").isNotNull())


def run_profiles(plans: DataFrame, brands: DataFrame, lexicon: Lexicon = HOSPITALITY) -> DataFrame:
    cols = ["project_id", "brand_name", "brand_norms", "brand_site", "competitor_names", "competitor_norms", "competitor_sites"]
    return plans.select("run_id", "project_id").join(brand_profile(brands, lexicon).select(*cols), "project_id")


def display_name(name: Column, norm: Column) -> Column:
    """The brand's own name, else the first matching listed competitor, else itself."""
    return F.when(any_same(F.col("brand_norms"), norm), F.col("brand_name")).otherwise(
        F.coalesce(first_same(F.col("competitor_names"), F.col("competitor_norms"), norm), name)
    )


def role_of(norm: Column) -> Column:
    return (
        F.when(any_same(F.col("brand_norms"), norm), "brand").when(any_same(F.col("competitor_norms"), norm), "competitor").otherwise("other")
    )


def mention_rows(samples: DataFrame) -> DataFrame:
    m = successful(samples).select("run_id", "prompt_index", "iteration", F.posexplode("mentions").alias("pos", "m"))
    return m.select(
        "run_id", "prompt_index", "iteration", "pos", F.coalesce(F.nullif(F.col("m.canonical"), F.lit("")), F.col("m.name")).alias("name"),
        F.col("m.position").alias("position"), F.col("m.sentiment").alias("sentiment"),
    )


def named_businesses(samples: DataFrame, profiles: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct names per run in order of appearance, with their display name:
    answers first, then the brand, competitors and top places."""
    def seq(group: int, *parts: Column) -> Column:
        filled = [p.cast("long") for p in parts] + [F.lit(0).cast("long")] * (3 - len(parts))
        return F.struct(F.lit(group).alias("g"), *[p.alias(f"s{i}") for i, p in enumerate(filled)])

    mentioned = mention_rows(samples).select(
        "run_id", "name", seq(0, F.col("prompt_index"), F.col("iteration"), F.col("pos")).alias("seen")
    )
    own = profiles.select("run_id", F.col("brand_name").alias("name"), seq(1).alias("seen"))
    rivals = profiles.select("run_id", F.posexplode("competitor_names").alias("i", "name")).select("run_id", "name", seq(2, F.col("i")).alias("seen"))
    # The first ten of the list, however its reader counts: ord is 0-based in one and 1-based in another.
    first = places.filter(F.col("list") == "maps").groupBy("run_id").agg(F.min("ord").alias("_first"))
    listed = places.join(first, "run_id", "left").filter((F.col("list") == "local_pack") | ((F.col("list") == "maps") & (F.col("ord") < F.col("_first") + TOP_PLACES)))
    local = listed.select("run_id", F.col("title").alias("name"), seq(3, F.when(F.col("list") == "maps", 0).otherwise(1), F.col("ord")).alias("seen"))
    every = mentioned.unionByName(own).unionByName(rivals).unionByName(local)
    firsts = every.groupBy("run_id", "name").agg(F.min("seen").alias("seen"))
    known = firsts.join(profiles.select("run_id", "brand_name", "brand_norms", "competitor_names", "competitor_norms"), "run_id")
    shown = known.withColumn("display", display_name(F.col("name"), normalize_name(F.col("name"))))
    return shown.select("run_id", "name", "seen", "display", normalize_name(F.col("display")).alias("norm"))


def _appearance(seen: Column) -> Column:
    """Order-preserving key of the appearance struct (decimal text as wide as any long)."""
    return F.concat(*[F.lpad(seen[f].cast("string"), 19, "0") for f in ("g", "s0", "s1", "s2")])


def name_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord_a, ord_b (ord_a < ord_b) of the same business, on normalised names: an equality
    join of whole names with names and their whole-word prefixes, either way."""
    every = lambda f: F.explode(F.concat(F.array(f), proper_prefixes(f)))
    whole_a, whole_b = (x.select(*keys, F.col("ord").alias(f"ord_{s}"), F.col("feature").alias("p")) for x, s in ((a, "a"), (b, "b")))
    cut_a, cut_b = (x.select(*keys, F.col("ord").alias(f"ord_{s}"), every(F.col("feature")).alias("p")) for x, s in ((a, "a"), (b, "b")))
    met = whole_a.join(cut_b, [*keys, "p"]).unionByName(cut_a.join(whole_b, [*keys, "p"]))
    return met.filter("ord_a < ord_b").select(*keys, "ord_a", "ord_b").distinct()


def mention_clusters(named: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(run_id, name, display, cluster, business, cluster_seen): greedy first-seen
    clustering of names. ``named`` holds one row per distinct name and run."""
    named = cut_lineage(named)
    seen = _appearance(F.col("seen"))
    # One row per distinct norm, ordered by its first appearance.
    norms = cut_lineage(named.filter(F.col("norm") != "").groupBy("run_id", "norm").agg(
        F.min(seen).alias("ord"), F.min_by("display", seen).alias("business")
    ))
    led = leader_clusters(
        norms.select("run_id", "ord", F.col("norm").alias("feature")), ["run_id"], lambda a, b: name_pairs(a, b, ["run_id"]), local_edges=local_edges
    )
    leaders = norms.select("run_id", F.col("ord").alias("leader_ord"), F.col("norm").alias("cluster"), "business")
    cluster_of = led.join(leaders, ["run_id", "leader_ord"]).select(
        "run_id", F.col("feature").alias("norm"), "cluster", "business", F.col("leader_ord").alias("cluster_seen")
    )
    cols = ["run_id", "name", "display", "cluster", "business", "cluster_seen"]
    rows = named.filter(F.col("norm") != "").join(cluster_of, ["run_id", "norm"]).select(*cols)
    bare = named.filter(F.col("norm") == "").withColumn("cluster", F.lower("display"))
    firsts = bare.groupBy("run_id", "cluster").agg(F.min_by("display", seen).alias("business"), F.min(seen).alias("cluster_seen"))
    return cut_lineage(rows.unionByName(bare.join(firsts, ["run_id", "cluster"]).select(*cols)))


def cited_domains(samples: DataFrame, profiles: DataFrame, limit: int = 25) -> DataFrame:
    """Most cited domains per run, with their kind."""
    cited = successful(samples).select("run_id", "prompt_index", "iteration", F.posexplode("citations").alias("i", "c"))
    counted = cited.groupBy("run_id", F.col("c.domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("prompt_index", "iteration", "i")).alias("seen")
    )
    return top_rows(counted, ["run_id"], [F.desc("count"), "seen"], limit).join(
        profiles.select("run_id", "brand_site", "competitor_sites"), "run_id"
    ).select("run_id", "rank", "domain", "count", domain_kind(F.col("domain"), F.col("brand_site"), F.col("competitor_sites")).alias("kind"))


def visibility_summary(
    brands: DataFrame,
    plans: DataFrame,
    places: DataFrame,
    samples: DataFrame,
    lexicon: Lexicon = HOSPITALITY,
    top_domains: int = 25,
) -> dict[str, DataFrame]:
    """``plans``: run_id, project_id, prompts array<struct<prompt,angle>>.
    ``places``: run_id, list (maps | local_pack), ord, position, title, rating, reviews.
    Returns the frames businesses, domains, per_prompt and summary."""
    profiles = run_profiles(plans, brands, lexicon)
    named = named_businesses(samples, profiles, places)
    clusters = mention_clusters(named)
    ok = successful(samples)
    totals = samples.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if((F.coalesce("error", F.lit("")) == "") & F.col("mentions").isNotNull()).alias("successful_samples"),
        F.sum(F.when((F.coalesce("error", F.lit("")) == "") & F.col("mentions").isNotNull(), F.size(F.coalesce("citations", F.array().cast(f"array<{CITATION}>")))).otherwise(0)).alias("citation_total"),
    )

    # --- mentions per business: the first mention of a business in an answer counts
    m = mention_rows(samples).join(clusters.select("run_id", "name", "cluster"), ["run_id", "name"])
    once = m.groupBy("run_id", "prompt_index", "iteration", "cluster").agg(F.min_by(F.struct("position", "sentiment"), "pos").alias("f"))
    stats = once.groupBy("run_id", "cluster").agg(
        F.count(F.lit(1)).alias("ai_mentions"),
        F.count(F.lit(1)).alias("ai_samples"),
        F.count_distinct("prompt_index").alias("ai_prompts"),
        F.avg("f.position").alias("ai_avg_position"),
        *[F.count_if(F.col("f.sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")],
    )
    titles = clusters.groupBy("run_id", "cluster").agg(F.min("business").alias("name"), F.min("cluster_seen").alias("seen"))
    ranks = first_match(
        titles.select("run_id", "name"), places, "name", "title", ["run_id"], ["ord"], ["ord", "position", "rating", "reviews"],
        by="list", values=("maps", "local_pack"),
    ).select(
        "run_id", "name", F.col("maps_position").alias("maps_rank"), F.col("maps_rating"), F.col("maps_reviews"),
        F.col("local_pack_position").alias("local_pack_rank"), F.col("maps_ord").isNotNull().alias("in_maps"), F.col("local_pack_ord").isNotNull().alias("in_pack"),
    )
    norm = normalize_name(F.col("name"))
    zero = F.lit(0).cast("long")
    in_ai = F.col("ai_mentions") > 0
    in_serp = (F.coalesce("in_maps", F.lit(False)) & F.coalesce(F.col("maps_rank") <= 10, F.lit(False))) | F.coalesce("in_pack", F.lit(False))
    businesses = (
        titles.join(stats, ["run_id", "cluster"], "left")
        .join(ranks, ["run_id", "name"], "left")
        .join(profiles.select("run_id", "brand_norms", "competitor_norms"), "run_id")
        .join(totals.select("run_id", "successful_samples"), "run_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("ai_mentions", "ai_samples", "ai_prompts", "positive", "neutral", "negative")})
        .select(
            "run_id", "cluster", "name", role_of(norm).alias("role"), "ai_mentions", "ai_samples",
            (F.col("ai_samples") / F.greatest(F.coalesce("successful_samples", zero), F.lit(1))).alias("ai_mention_rate"),
            "ai_avg_position", "ai_prompts", "positive", "neutral", "negative", "maps_rank", "maps_rating", "maps_reviews", "local_pack_rank",
            F.when(in_ai & in_serp, "both").when(in_ai, "ai_only").when(in_serp, "serp_only").otherwise("neither").alias("gap"), "seen",
        )
    )

    domains = cited_domains(samples, profiles, top_domains)

    # --- per prompt: display names, once per answer
    shown = mention_rows(samples).join(clusters.select("run_id", "name", "display"), ["run_id", "name"])
    per_answer = shown.groupBy("run_id", "prompt_index", "iteration", "display").agg(F.min("pos").alias("pos"))
    roles = clusters.select("run_id", "display").distinct().join(profiles.select("run_id", "brand_norms", "competitor_norms"), "run_id").select(
        "run_id", "display", (role_of(normalize_name(F.col("display"))) == "brand").alias("is_brand")
    )
    named_answers = per_answer.join(roles, ["run_id", "display"])
    brand_answers = named_answers.filter("is_brand").select("run_id", "prompt_index", "iteration").distinct().groupBy("run_id", "prompt_index").agg(F.count(F.lit(1)).alias("brand_hits"))
    answers = ok.groupBy("run_id", "prompt_index").agg(F.count(F.lit(1)).alias("answers"))
    counts = per_answer.groupBy("run_id", "prompt_index", "display").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("iteration", "pos")).alias("seen"))
    top = top_rows(counts, ["run_id", "prompt_index"], [F.desc("n"), "seen"], 5).groupBy("run_id", "prompt_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "display"))), lambda x: x["display"]).alias("top")
    )
    prompts = plans.select("run_id", F.posexplode("prompts").alias("prompt_index", "p")).select("run_id", "prompt_index", "p.prompt", "p.angle")
    at = ["run_id", "prompt_index"]
    per_prompt = (
        prompts.join(answers, at, "left").join(brand_answers, at, "left").join(top, at, "left")
        .select(
            *at, "prompt", "angle",
            F.when(F.coalesce("answers", zero) > 0, F.coalesce("brand_hits", zero) / F.col("answers")).otherwise(0.0).alias("brand_rate"),
            F.coalesce("top", F.array().cast("array<string>")).alias("top"),
        )
    )

    # --- run totals; the brand is the best placed business with that role
    best = businesses.filter(F.col("role") == "brand").groupBy("run_id").agg(
        F.min_by(F.struct("name", "ai_mentions", "ai_mention_rate", "maps_rank", "local_pack_rank", "gap"),
                 F.struct((-F.col("ai_mention_rate")).alias("a"), F.coalesce("maps_rank", F.lit(99)).alias("b"), "seen")).alias("brand")
    )
    all_mentions = stats.groupBy("run_id").agg(F.sum("ai_mentions").alias("mention_total"))
    per = F.greatest(F.col("successful_samples"), F.lit(1))
    summary = (
        totals.join(all_mentions, "run_id", "left").join(best, "run_id", "left")
        .withColumn("mention_total", F.coalesce("mention_total", zero))
        .select(
            "run_id", "total_samples", "successful_samples", (F.col("mention_total") / per).alias("avg_mentions_per_answer"),
            (F.col("citation_total") / per).alias("avg_citations_per_answer"), "brand",
            F.when(F.col("brand").isNotNull() & (F.col("mention_total") > 0), F.col("brand.ai_mentions") / F.col("mention_total")).otherwise(0.0).alias("brand_share_of_voice"),
        )
    )
    return {"businesses": businesses, "domains": domains, "per_prompt": per_prompt, "summary": summary}


def ranked_businesses(businesses: DataFrame, limit: int = 40) -> DataFrame:
    order = [F.desc("ai_mention_rate"), F.coalesce("maps_rank", F.lit(99)), "seen"]
    return top_rows(businesses, ["run_id"], order, limit).drop("seen")


def dedupe_citations(citations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per answer and URL, the first one. ``citations``: keys, ord, url, title."""
    return citations.groupBy(*keys, "url").agg(F.min(F.struct("ord", "title")).alias("f")).select(*keys, "url", F.col("f.ord").alias("ord"), F.col("f.title").alias("title"))
