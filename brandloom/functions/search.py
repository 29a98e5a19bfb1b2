"""Search intent, click curve, result formats and content parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import ascii_view, js_pattern, js_round, let, matches, trim_ws
from brandloom.functions.text import fold, paragraphs, words

EMPTY = "array<string>"


def empty_array(kind: str = EMPTY) -> Column:
    return F.array().cast(kind)


def keep_hits(*tests: tuple[Column, str | Column]) -> Column:
    """Values whose test holds, in the given order."""
    return F.array_compact(F.array(*[F.when(t, v if isinstance(v, Column) else F.lit(v)) for t, v in tests]))


# --- intent -----------------------------------------------------------------------


def classify_intent(query: Column, folded_brand_names: Column) -> Column:
    """struct(primary, all, label) for a query; the names are already folded."""

    def found(q: Column, a: Column) -> Column:
        names = F.exists(folded_brand_names, lambda b: (b != "") & F.contains(q, b))
        hits = keep_hits((F.coalesce(names, F.lit(False)), "Navigational"), *[(matches(a, p), i) for i, p in V.INTENT_PATTERNS])
        fallback = F.when(matches(a, V.INTENT_FALLBACK_PATTERN), F.lit("Commercial investigation")).otherwise(F.lit("Informational"))
        return let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(fallback)))

    def ordered(every: Column, a: Column) -> Column:
        investigate = (
            F.array_contains(every, "Commercial investigation")
            & F.array_contains(every, "Transactional")
            & ~matches(a, V.INTENT_BOOKING_PATTERN)
        )
        primary = F.when(investigate, F.lit("Commercial investigation")).otherwise(F.get(every, F.lit(0)))
        return let(primary, lambda p: F.concat(F.array(p), F.array_remove(every, p)))

    def labelled(o: Column) -> Column:
        short = F.transform(F.slice(o, 1, 2), lambda i: F.when(i == "Commercial investigation", F.lit("Commercial")).otherwise(i))
        first = F.get(o, F.lit(0))
        label = F.when(F.size(o) > 1, F.array_join(short, " + ")).otherwise(first)
        return F.struct(first.alias("primary"), o.alias("all"), label.alias("label"))

    def whole(q: Column) -> Column:
        return let(ascii_view(q), lambda a: let(let(found(q, a), lambda e: ordered(e, a)), labelled))

    return let(fold(query), whole)


def expected_ctr(position: Column) -> Column:
    curve = F.array(*[F.lit(v) for v in V.CTR_CURVE])
    slot = F.greatest(js_round(position), F.lit(1)).cast("int")
    return (
        F.when(position <= 10, F.get(curve, F.least(slot, F.lit(len(V.CTR_CURVE))) - 1))
        .when(position <= 20, F.lit(V.CTR_SECOND_PAGE))
        .otherwise(F.lit(V.CTR_BEYOND))
    )


def localize(query: Column, city: Column) -> Column:
    c = trim_ws(F.coalesce(city, F.lit("")))
    known = (c == "") | F.contains(F.lower(query), F.lower(c))
    return F.when(known, query).otherwise(F.concat_ws(" ", query, c))


def place_string(city: Column, region: Column, country: Column) -> Column:
    return F.array_join(F.filter(F.array(city, region, country), lambda x: x.isNotNull() & (x != "")), ", ")


def number_text(x: Column) -> Column:
    """A coordinate as plain digits, all of them, without a closing ``.0`` and without an exponent."""
    x = x.cast("double")
    s, size = x.cast("string"), F.abs(x)
    part = lambda k: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -part(4).try_cast("int") - 1), part(2), part(3))
    plain = F.when((size > 0) & (size < 1e-3), small).when(size < 1e7, s).otherwise(s.try_cast("decimal(38,18)").cast("string"))
    return F.regexp_replace(plain, r"\.?0+\z", "")


def map_view(latitude: Column, longitude: Column) -> Column:
    """Map position of a search; NULL unless both coordinates are known."""
    return F.concat(F.lit("@"), number_text(latitude), F.lit(","), number_text(longitude), F.lit(V.MAP_ZOOM))


def search_locale(
    serp_location: Column, city: Column, region: Column, country: Column, code: Column, language: Column, latitude: Column, longitude: Column,
) -> Column:
    """Where a brand is searched from: place, canonical location, country, language and map position."""
    place = place_string(city, region, country)
    return F.struct(
        place.alias("place"),
        F.coalesce(F.nullif(serp_location, F.lit("")), F.nullif(place, F.lit(""))).alias("location"),
        F.nullif(F.lower(code), F.lit("")).alias("gl"),
        F.coalesce(F.nullif(language, F.lit("")), F.lit("en")).alias("hl"),
        map_view(latitude, longitude).alias("ll"),
    )


# --- results and domains -------------------------------------------------------------


def suffix_of_any(domain: Column, sites: Column) -> Column:
    return F.coalesce(F.exists(sites, lambda s: (s != "") & F.endswith(domain, s)), F.lit(False))


def result_format(title: Column, link: Column, domain: Column, brand_site: Column, competitor_sites: Column) -> Column:
    own = (F.coalesce(brand_site, F.lit("")) != "") & F.endswith(domain, brand_site)

    def by_title(t: Column) -> Column:
        return (
            F.when(matches(t, V.LISTICLE_TITLE), "Listicle")
            .when(matches(t, V.COMPARISON_TITLE), "Comparison")
            .when(matches(t, V.GUIDE_TITLE), "Guide")
            .when(matches(t, V.REVIEW_TITLE) | domain.rlike("tripadvisor"), "Review")
            .otherwise("Article / page")
        )

    return (
        F.when(own, "Brand page")
        .when(suffix_of_any(domain, competitor_sites), "Competitor page")
        .when(domain.rlike(V.OTA_DOMAINS), "OTA listing")
        .when(F.concat(domain, link).rlike(V.FORUM_RESULT), "Forum thread")
        .otherwise(let(ascii_view(fold(title)), by_title))
    )


def domain_kind(domain: Column, brand_site: Column, competitor_sites: Column) -> Column:
    d = F.lower(domain)
    own = (F.coalesce(brand_site, F.lit("")) != "") & F.endswith(d, F.lower(brand_site))
    return (
        F.when(own, "brand site")
        .when(d.rlike(V.CITATION_OTA_DOMAINS), "OTA")
        .when(d.rlike(V.CITATION_REVIEW_DOMAINS), "reviews / maps")
        .when(d.rlike(V.CITATION_FORUM_DOMAINS), "forum")
        .when(suffix_of_any(d, competitor_sites), "competitor site")
        .otherwise("editorial / other")
    )


def sentiment(sentence: Column, rating: Column, positive: str = V.POSITIVE_WORDS, negative: str = V.NEGATIVE_WORDS) -> Column:
    def sign(s: Column) -> Column:
        return F.sign(F.regexp_count(s, F.lit(positive)) - F.regexp_count(s, F.lit(negative))).cast("int")

    def judged(v: Column) -> Column:
        return F.when(v != 0, v).when(rating >= 4, 1).when(rating <= 2, -1).otherwise(0)

    return let(let(ascii_view(fold(sentence)), sign), judged)


# --- questions ------------------------------------------------------------------------


def clean_forum_title(c: Column) -> Column:
    for p in V.FORUM_TITLE_SUFFIXES:
        c = F.regexp_replace(c, "(?i)" + js_pattern(p), "")
    return trim_ws(c)


def is_question(text: Column) -> Column:
    return (F.length(text) >= 8) & matches(ascii_view(text), V.QUESTION_LIKE, ignore_case=True)


# --- content parsing --------------------------------------------------------------------

_MD_HEADING = "(?m)" + V.MD_HEADING.replace("\\s", V.WS_CLASS)
_HTML_HEADING = "(?is)" + V.HTML_HEADING
_MD_LINK = V.MD_LINK
_HTML_LINK = "(?is)" + V.HTML_LINK


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _found(c: Column, pattern: str, sign: str) -> Column:
    """Matches of a pattern that begins with ``sign``; a text without it is not searched."""
    return F.when(~F.contains(c, F.lit(sign)), empty_array()).otherwise(_all(c, pattern, 0))


def _group(match: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(match, pattern, group)


def headings(c: Column) -> Column:
    """Markdown headings first, then HTML ones: array<struct<level,text>>."""
    md = F.transform(
        _found(c, _MD_HEADING, "#"),
        lambda m: F.struct(F.length(_group(m, _MD_HEADING, 1)).alias("level"), trim_ws(_group(m, _MD_HEADING, 2)).alias("text")),
    )
    html = F.transform(
        _found(c, _HTML_HEADING, "<"),
        lambda m: F.struct(_group(m, _HTML_HEADING, 1).cast("int").alias("level"), trim_ws(F.regexp_replace(_group(m, _HTML_HEADING, 2), V.TAG, "")).alias("text")),
    )
    return F.concat(md, html)


def links(c: Column) -> Column:
    """Markdown links first, then HTML ones: array<struct<text,url>>."""
    md = F.transform(_found(c, _MD_LINK, "["), lambda m: F.struct(_group(m, _MD_LINK, 1).alias("text"), _group(m, _MD_LINK, 2).alias("url")))
    html = F.transform(
        _found(c, _HTML_LINK, "<"), lambda m: F.struct(F.regexp_replace(_group(m, _HTML_LINK, 2), V.TAG, "").alias("text"), _group(m, _HTML_LINK, 1).alias("url"))
    )
    return F.concat(md, html)


def plain_text(c: Column) -> Column:
    c = let(c, lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, V.TAG, " ")).otherwise(t))
    c = F.regexp_replace(c, V.MD_LINK_TEXT, "$1")
    c = F.regexp_replace(c, "(?m)" + V.MD_HEADING_MARK.replace("\\s", V.WS_CLASS), "")
    return F.regexp_replace(c, V.MD_SIGNS, "")


def parse_content(c: Column) -> Column:
    plain = plain_text(c)
    return F.struct(
        headings(c).alias("headings"), links(c).alias("links"), plain.alias("plain"),
        paragraphs(plain).alias("paragraphs"), words(plain).alias("words"),
    )


def skipped_level(hs: Column) -> Column:
    """True when a heading is more than one level deeper than the one before."""

    def jumps(levels: Column) -> Column:
        steps = F.zip_with(F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), levels, lambda b, a: b - a)
        return F.coalesce(F.exists(steps, lambda d: d > 1), F.lit(False))

    return let(F.transform(hs, lambda h: h["level"]), jumps)


def claim_phrase(c: Column) -> Column:
    for p in V.CLAIM_PREFIXES:
        c = F.regexp_replace(c, "(?i)" + js_pattern(p), "")
    return trim_ws(F.regexp_replace(c, r"[.]+\z", ""))


def banned_from_rules(rules: Column) -> Column:
    """Phrases a negative rule quotes, or the noun it says never to use."""

    def mined(r: Column) -> Column:
        quoted = _all(r, V.QUOTED_PHRASE, 1)
        noun = F.regexp_extract(r, "(?i)" + V.NEVER_CALL, 1)
        found = F.concat(quoted, F.when(noun != "", F.array(noun)).otherwise(empty_array()))
        return F.when(matches(ascii_view(r, "’“”"), V.NEGATIVE_RULE, ignore_case=True), found).otherwise(empty_array())

    trimmed = F.transform(F.flatten(F.transform(rules, mined)), trim_ws)
    return F.array_distinct(F.filter(trimmed, lambda s: s != ""))
