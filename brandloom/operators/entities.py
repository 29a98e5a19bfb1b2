"""Named entities that several texts of one group keep mentioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.names import any_same, normalize_folded
from brandloom.functions.regex import ascii_view, js_pattern, let, matches
from brandloom.functions.search import empty_array
from brandloom.functions.text import fold
from brandloom.operators.topics import top_rows
from brandloom.session import cut_lineage

# The boundary before a run is an ASCII one, while the text keeps its accented letters.
_RUN = js_pattern(V.CAPITALISED_RUN).replace("\\b", "(?<![A-Za-z0-9_])", 1)


def capitalised_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(1))


def trim_edges(run: Column) -> Column:
    """Words of a run without the generic words at either end."""
    cut = F.regexp_replace(run, "[.’']+\\z", "")
    parts = F.filter(F.split(cut, V.WS_CLASS + "+"), lambda w: w != "")

    def keep_from(ws: Column, plain_quotes: bool) -> Column:
        def edge(w: Column) -> Column:
            f = fold(w)
            return (F.replace(f, F.lit("’"), F.lit("'")) if plain_quotes else f).isin(V.ENTITY_EDGE)

        def cut_at(words: Column, first: Column) -> Column:
            return F.when(first == 0, empty_array()).otherwise(F.slice(words, F.greatest(first, F.lit(1)), F.greatest(F.size(words), F.lit(1))))

        return let(ws, lambda x: let(F.array_position(F.transform(x, edge), F.lit(False)).cast("int"), lambda i: cut_at(x, i)))

    return F.reverse(keep_from(F.reverse(keep_from(parts, True)), False))


def entity_candidates(text: Column) -> Column:
    """array<struct<name,folded>>: first spelling of each entity name in one text."""

    def shaped(run: Column) -> Column:
        def named(parts: Column) -> Column:
            joined = F.array_join(parts, " ")
            return let(joined, lambda name: F.struct(name.alias("name"), fold(name).alias("folded"), F.size(parts).alias("n")))

        return let(trim_edges(run), named)

    def keep(x: Column) -> Column:
        lone = x["n"] == 1
        possessive = F.lower(x["name"]).rlike("['’]s\\z")
        business = matches(ascii_view(x["folded"]), V.ENTITY_BUSINESS)
        return (
            (F.length(x["name"]) >= 3) & ~x["folded"].isin(V.ENTITY_GENERIC) & ~x["name"].rlike("^[0-9]")
            & ~(lone & possessive) & ~(lone & business)
        )

    return F.filter(F.transform(capitalised_runs(text), shaped), keep)


def _excluded(name_folded: Column, folds: Column, exclude_words: Column, business_norms: Column) -> Column:
    fragment = let(
        F.split(name_folded, V.WS_CLASS + "+"),
        lambda own: F.exists(exclude_words, lambda ws: F.forall(own, lambda w: F.array_contains(ws, w))),
    )
    return F.array_contains(folds, name_folded) | any_same(business_norms, normalize_folded(name_folded)) | fragment


def extract_entities(
    docs: DataFrame,
    keys: list[str],
    context: DataFrame | None = None,
    limit: int = 15,
) -> DataFrame:
    """``docs``: keys, ord, text. ``context``: keys, exclude (names), exclude_businesses,
    businesses; all optional arrays. Names are counted once per text."""
    if context is None:
        context = docs.select(*keys).distinct().select(
            *keys, *[empty_array().alias(c) for c in ("exclude", "exclude_businesses", "businesses")]
        )
    ctx = context.select(
        *keys,
        F.transform(F.filter("exclude", lambda e: F.coalesce(e, F.lit("")) != ""), fold).alias("_folds"),
        F.transform("exclude_businesses", lambda b: normalize_folded(fold(b))).alias("_biz"),
        F.transform("businesses", lambda b: normalize_folded(fold(b))).alias("_local"),
    ).withColumn("_words", F.transform("_folds", lambda f: F.split(f, V.WS_CLASS[:-1] + ",]+")))
    texts = docs.filter(F.coalesce("text", F.lit("")) != "")
    n_docs = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
    found = texts.select(*keys, "ord", F.posexplode(entity_candidates(F.col("text"))).alias("pos", "c")).select(
        *keys, "ord", "pos", "c.name", "c.folded"
    )
    # Count texts per name: one row per (text, name) first, both steps map-side combined.
    per_doc = found.groupBy(*keys, "folded", "ord").agg(F.min(F.struct("pos", "name")).alias("first"))
    counted = per_doc.groupBy(*keys, "folded").agg(
        F.count(F.lit(1)).alias("mentions"), F.min(F.struct("ord", F.col("first.pos"), F.col("first.name"))).alias("seen")
    )
    allowed = cut_lineage(
        counted.join(ctx, keys)
        .filter(~_excluded(F.col("folded"), F.col("_folds"), F.col("_words"), F.col("_biz")))
        .select(*keys, "folded", "mentions", F.col("seen.name").alias("name"), "seen", F.size(F.split("folded", " ")).alias("n_words"))
    )
    # A name is partial when a longer name ends with it: compare with the proper
    # word suffixes of every name.
    tokens = F.split("folded", " ")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(tokens), F.lit(2))), lambda i: F.array_join(F.slice(tokens, i, F.size(tokens)), " "))
    longer = (
        allowed.filter(F.size(tokens) > 1)
        .select(*keys, F.length("name").alias("_len"), F.explode(suffixes).alias("folded"))
        .groupBy(*keys, "folded").agg(F.max("_len").alias("_len"))
    )
    kept = (
        allowed.join(longer, [*keys, "folded"], "left")
        .filter(F.col("_len").isNull() | (F.col("_len") <= F.length("name")))
        .join(n_docs, keys)
        .filter((F.col("mentions") >= F.when(F.col("n_docs") >= 6, 2).otherwise(1)) & (F.size(F.split("name", " ")) <= 5))
    )
    ranked = top_rows(kept, keys, [F.desc("mentions"), F.desc("n_words"), "seen"], limit)
    typed = ranked.join(ctx.select(*keys, "_local"), keys)
    f = ascii_view(F.col("folded"))
    kind = (
        F.when(any_same(F.col("_local"), normalize_folded(F.col("folded"))) | matches(f, V.ENTITY_BUSINESS), "Business")
        .when(matches(f, V.ENTITY_LANDMARK), "Landmark")
        .when(F.col("n_words") == 1, "Place")
        .otherwise("Entity")
    )
    return typed.select(*keys, "rank", "name", kind.alias("type"), "mentions")
