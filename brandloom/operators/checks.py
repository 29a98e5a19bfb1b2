"""Rule checks on content drafts: one narrow pass per draft, then area scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.functions.regex import ascii_view, js_round, let, matches, trim_ws
from brandloom.functions.search import (
    banned_from_rules, claim_phrase, empty_array, headings, links, plain_text, skipped_level, suffix_of_any,
)
from brandloom.functions.text import (
    domain_of, drop_stopwords, ellipsis, fold, fold_phrase, folded_contains, lines, paragraphs, sentences, share_within, without, words_of,
)
from brandloom.operators.brands import brand_profile

PASS, WARN, FAIL = "pass", "warn", "fail"
CHECK = "struct<id:string,area:string,status:string,label:string,detail:string,fix:string,evidence:array<string>>"


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _status(ok: Column, other: str) -> Column:
    return F.when(ok, PASS).otherwise(other)


def _graded(value: Column, good, fair) -> Column:
    return F.when(value >= good, PASS).when(value >= fair, WARN).otherwise(FAIL)


def _check(id: str, area: str, status: Column, label, detail, fix=None, evidence: Column | None = None) -> Column:
    def text(x) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return F.struct(
        F.lit(id).alias("id"), F.lit(area).alias("area"), status.alias("status"), text(label).alias("label"), text(detail).alias("detail"),
        text(fix).alias("fix"), (evidence if evidence is not None else empty_array()).alias("evidence"),
    )


def _s(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def _cat(*parts) -> Column:
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _names_any(folded_text: Column, folded_names: Column) -> Column:
    return _any(folded_names, lambda n: folded_contains(folded_text, n))


def split_phrases(text: Column) -> Column:
    """Comma-separated phrases of a multi-line field."""
    return F.flatten(F.transform(lines(text), lambda l: F.split(l, ",")))


def name_variants(official: Column, aliases: Column, kind: str, tokens: Column, folds: Column, ends: Column) -> Column:
    """Word runs that are close to an official name but spelled differently.

    ``folds``: the tokens folded, ``ends``: folded without closing punctuation, as the last word
    of a run stands. A run of one edit holds the first or the second half of the name."""
    known = F.transform(F.coalesce(aliases, empty_array()), fold)
    word = lambda words, i: F.get(words, i)

    def run(i: Column, size: Column) -> Column:
        last = word(ends, i + size - 1)
        return F.when(size == 1, last).otherwise(F.concat_ws(" ", F.slice(folds, i + 1, size - 1), last))

    def shown(i: Column, size: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(tokens, i + 1, size), " "), r"[.,;:!?)]+\z", "")

    def close(f: Column, t: Column, reach: Column, names: Column, halves: Column) -> Column:
        near = F.abs(F.length(f) - F.length(t)) <= reach
        held = (reach > 1) | F.contains(f, halves["a"]) | F.contains(f, halves["b"])
        return near & held & (f != t) & ~F.array_contains(names, f) & (F.levenshtein(f, t) <= reach)

    def issues(t: Column, reach: Column, size: Column, names: Column, halves: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - size, F.lit(0)))
        hits = F.filter(starts, lambda i: let(run(i, size), lambda f: close(f, t, reach, names, halves)))
        found = F.transform(hits, lambda i: _cat(f"{kind}: “", shown(i, size), "” → “", official, "”"))
        return F.when((F.size(tokens) >= size) & (F.length(t) >= 6), found).otherwise(empty_array())

    reach_of = lambda t: F.greatest(F.lit(1), F.floor(F.length(t) / 8)).cast("int")
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    halves_of = lambda t: F.struct(t.substr(F.lit(1), half(t)).alias("a"), t.substr(half(t) + 1, F.length(t)).alias("b"))
    size = F.size(F.split(official, V.WS_CLASS + "+"))
    return let(known, lambda ks: let(fold(official), lambda t: let(reach_of(t), lambda r: let(size, lambda n: let(halves_of(t), lambda h: issues(t, r, n, ks, h))))))


def draft_features(drafts: DataFrame, brands: DataFrame, rules: DataFrame | None, lexicon: Lexicon) -> DataFrame:
    """Everything the checks read, each token list computed once per draft.

    ``drafts``: draft_id, project_id, content, keyword, required_entities.
    ``rules``: project_id, rank, content (60 rows per project at most, see ``active_rules``)."""
    profile = brand_profile(brands, lexicon).withColumn(
        "alias_names", F.transform("competitors", lambda c: F.concat(F.array(c["name"]), F.coalesce(c["aliases"], empty_array())))
    )
    if rules is not None:
        texts = rules.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"]).alias("rule_texts"))
        profile = profile.join(texts, "project_id", "left")
    else:
        profile = profile.withColumn("rule_texts", empty_array())
    strip_quotes = lambda s: trim_ws(F.regexp_replace(s, "[\"“”]", ""))
    long_enough = lambda s: F.length(s) > 2
    profile = profile.select(
        "project_id", "brand_name", "brand_aliases", "brand_site", "competitors", "site_pages", "audience", "cta_preference", "english_variant",
        "brand_facts", "usps", "products",
        F.coalesce("city", F.lit("")).alias("city"),
        F.transform("brand_names", fold_phrase).alias("brand_phrases"),
        F.concat(lines(F.col("brand_facts")), lines(F.col("usps"))).alias("stated_facts"),
        F.filter(F.transform(lines(F.col("restricted_claims")), claim_phrase), long_enough).alias("restricted"),
        F.filter(F.transform(F.concat(split_phrases(F.col("words_to_avoid")), banned_from_rules(F.coalesce("rule_texts", empty_array()))), strip_quotes), long_enough).alias("avoid"),
        F.filter(F.transform(split_phrases(F.col("words_to_use")), trim_ws), long_enough).alias("preferred"),
        F.transform("alias_names", lambda ns: F.transform(ns, fold_phrase)).alias("rival_phrases"),
        fold(F.concat_ws(" ", F.nullif("brand_facts", F.lit("")), F.nullif("usps", F.lit("")), F.nullif("products", F.lit("")))).alias("fact_text"),
        drop_stopwords(words_of(fold(F.coalesce("cta_preference", F.lit(""))))).alias("cta_words"),
    ).withColumns(
        {
            "city_phrase": fold_phrase(F.col("city")),
            "fact_words": F.transform("stated_facts", lambda f: drop_stopwords(words_of(fold(f)))),
        }
    )
    d = drafts.join(profile, "project_id")
    d = d.withColumns(
        {
            "keyword": F.nullif(trim_ws(F.coalesce("keyword", F.lit(""))), F.lit("")),
            "headings": headings(F.col("content")), "links": links(F.col("content")), "plain": plain_text(F.col("content")),
            "required_entities": F.coalesce("required_entities", empty_array()),
        }
    )
    d = d.withColumns({"plain_fold": fold(F.col("plain")), "paras": paragraphs(F.col("plain")), "sents": sentences(F.col("plain"))})
    d = d.withColumns(
        {
            "word_list": words_of(F.col("plain_fold")), "para_folds": F.transform("paras", fold), "sent_folds": F.transform("sents", fold),
            "plain_view": ascii_view(F.col("plain")), "sent_views": F.transform("sents", ascii_view),
            "kw_words": drop_stopwords(words_of(fold(F.coalesce("keyword", F.lit(""))))),
            "name_tokens": F.regexp_extract_all("plain", F.lit(r"[\p{L}\p{N}'’&.\-]+"), F.lit(0)),
        }
    )
    d = d.withColumns(
        {
            "folded_names": fold(F.array_join("name_tokens", " ")), "wc": F.size("word_list"), "first100": F.array_join(F.slice("word_list", 1, 100), " "),
            "sent_words": F.transform("sent_folds", lambda s: drop_stopwords(words_of(s))),
        }
    )
    return d.withColumns(  # tokens hold no blank, so the folded list can be cut at blanks
        {"name_folds": F.split("folded_names", " "), "name_ends": F.split(F.regexp_replace("folded_names", r"[.,;:!?)]+(?= |\z)", ""), " ")}
    )


Area = tuple[dict[str, Column], list[Column]]
Reader = Callable[[str], Column]
# Each area returns its metrics (computed once, as columns "m_<name>") and the
# checks that word them. Metrics read features through ``r``, bound once per draft:
# inside lambdas a plain column could be inlined and recomputed per element.


def _m(name: str) -> Column:
    return F.col("m_" + name)


def _seo(lexicon: Lexicon, r: Reader) -> Area:
    kw = r("keyword")

    def coverage(text: Column) -> Column:
        return share_within(r("kw_words"), drop_stopwords(words_of(fold(text))))

    hs = r("headings")
    target = fold(kw)
    times = let(
        target,
        lambda t: F.when(t == "", 0).otherwise(
            (F.length(r("plain_fold")) - F.length(F.replace(r("plain_fold"), t, F.lit("")))) / F.greatest(F.length(t), F.lit(1))
        ),
    ).cast("int")
    required = r("required_entities")
    urls = F.transform(r("site_pages"), lambda p: p["url"])
    inner = F.filter(
        r("links"),
        lambda l: F.startswith(l["url"], F.lit("/"))
        | (r("brand_site").isNotNull() & suffix_of_any(domain_of(l["url"]), F.array(F.coalesce(r("brand_site"), F.lit("")))))
        | F.array_contains(urls, l["url"]),
    )
    metrics = {
        "h1": F.get(F.filter(hs, lambda h: h["level"] == 1), F.lit(0))["text"],
        "h1_fit": F.coalesce(coverage(F.get(F.filter(hs, lambda h: h["level"] == 1), F.lit(0))["text"]) >= 0.6, F.lit(False)),
        "intro": share_within(r("kw_words"), drop_stopwords(F.slice(r("word_list"), 1, 100))) >= 0.75,
        "h2_fit": _any(hs, lambda h: (h["level"] == 2) & (coverage(h["text"]) >= 0.5)),
        "times": times,
        "n1": F.size(F.filter(hs, lambda h: h["level"] == 1)),
        "n2": F.size(F.filter(hs, lambda h: h["level"] == 2)),
        "skipped": skipped_level(hs),
        "missing": F.filter(required, lambda e: ~folded_contains(r("plain_fold"), fold_phrase(e))),
        "inner": F.size(inner),
    }
    density = F.when(F.col("wc") > 0, _m("times") * F.size("kw_words") / F.col("wc")).otherwise(0.0)
    has_kw = kw.isNotNull()
    h1, intro, h2, times, n1, n2, skipped, missing, inner = (
        _m(n) for n in ("h1", "intro", "h2_fit", "times", "n1", "n2", "skipped", "missing", "inner")
    )
    wc = F.col("wc")
    ratio = F.lit(1.0) - F.size(missing) / F.greatest(F.size(required), F.lit(1))
    pages = F.array_join(F.slice(F.transform("site_pages", lambda p: p["title"]), 1, 2), ", ")
    return metrics, [
        F.when(has_kw, _check("kw-h1", "seo", _status(_m("h1_fit"), FAIL), "Keyword in H1 / title",
               F.when(h1.isNotNull(), _cat("H1: “", h1, "”")).otherwise("No H1 found."), _cat("Put “", kw, "” (or a close variant) in the H1."))),
        F.when(has_kw, _check("kw-intro", "seo", _status(intro, WARN), "Keyword in the first 100 words",
               F.when(intro, "Found early in the intro.").otherwise("The intro doesn't clearly state the topic."), "Answer the query in the opening paragraph.")),
        F.when(has_kw, _check("kw-h2", "seo", _status(h2, WARN), "Keyword variant in a subheading",
               F.when(h2, "At least one H2 uses the topic.").otherwise("No H2 mentions the topic."), "Use a natural keyword variant in one H2.")),
        F.when(has_kw, _check("kw-density", "seo", F.when((density > 0.03) | (times == 0), WARN).otherwise(PASS), "Keyword usage",
               _cat("Exact phrase used ", times, "× (", F.format_number(density * 100, 1), "% of words)."),
               F.when(density > 0.03, "Reduce repetition; use synonyms.").when(times == 0, "Use the exact phrase at least once."))),
        F.when(~has_kw, _check("kw-none", "seo", F.lit(WARN), "Target keyword", "No target keyword set, so keyword checks were skipped.", "Add a target keyword.")),
        _check("headings", "seo", F.when((n1 == 1) & ((wc < 400) | (n2 >= 2)) & ~skipped, PASS).when((n1 > 1) | skipped, FAIL).otherwise(WARN), "Heading structure",
               _cat(n1, " H1, ", n2, " H2", F.when(skipped, ", skipped heading levels").otherwise(""), "."),
               F.when(n1 != 1, "Use exactly one H1.").when(skipped, "Don't jump from H2 to H4.").when(n2 < 2, "Break long content into H2 sections.")),
        _check("length", "seo", _graded(wc, 600, 300), "Content depth", _cat(F.format_number(wc, 0), " words."),
               F.when(wc < 600, "Most competitive hospitality pages run 800+ words.")),
        F.when(F.size(required) > 0, _check("entities", "seo", _graded(ratio, 0.7, 0.4), "Entity coverage",
               _cat(js_round(ratio * 100), "% of the entities top results mention."),
               F.when(F.size(missing) > 0, _cat("Mention: ", F.array_join(F.slice(missing, 1, 8), ", "), ".")), missing)),
        _check("internal-links", "seo", _graded(inner, 2, 1), "Internal links", _cat(inner, " internal link", _s(inner), " found."),
               F.when(inner < 2, _cat("Link to relevant pages", F.when(F.size("site_pages") > 0, _cat(" (e.g. ", pages, ")")).otherwise(" such as rooms, dining or offers"), "."))),
    ]


def _geo(lexicon: Lexicon, r: Reader) -> Area:
    brand, names = r("brand_name"), r("brand_phrases")
    has_city = r("city") != ""
    kw_audience = lexicon.audience_of(lexicon.topics_in(F.coalesce(r("keyword"), F.lit(""))))
    stated_facts = F.filter(
        F.arrays_zip(r("stated_facts"), r("fact_words")),
        lambda f: (F.size(f["fact_words"]) > 0) & _any(r("sent_words"), lambda s: share_within(f["fact_words"], s) >= 0.6),
    )
    audience = F.coalesce(F.get(kw_audience, F.lit(0)), F.get(r("audience"), F.lit(0))) if lexicon.audience else F.lit(None).cast("string")
    metrics = {
        "where": _any(
            F.arrays_zip(r("paras"), r("para_folds")),
            lambda p: p["paras"].rlike("[0-9]") & matches(ascii_view(p["paras"], "–"), V.DISTANCE, ignore_case=True) & _names_any(p["para_folds"], names),
        ),
        "stated": F.transform(stated_facts, lambda f: f["stated_facts"]),
        "audience": audience,
        "early": _names_any(r("first100"), names) & (~has_city | folded_contains(r("first100"), r("city_phrase"))),
        "asks": F.size(F.filter(r("headings"), lambda h: matches(ascii_view(h["text"]), V.QUESTION_HEADING, ignore_case=True))),
        "quotable": F.size(
            F.filter(
                F.arrays_zip(r("sents"), r("sent_folds")),
                lambda s: s["sents"].rlike("[0-9]") & (F.size(F.split(s["sents"], V.WS_CLASS + "+")) <= 35) & _names_any(s["sent_folds"], names),
            )
        ),
        # The paragraph test needs the audience, so it is resolved per topic id.
        "audience_paras": F.filter(r("para_folds"), lambda p: _names_any(p, names)),
    }
    where, stated, aud, early, asks, quotable = (_m(n) for n in ("where", "stated", "audience", "early", "asks", "quotable"))
    aud_label = F.lower(lexicon.label_of(aud))
    for_aud = let(aud, lambda a: _any(_m("audience_paras"), lambda p: F.array_contains(lexicon.topics_in_folded(p), a)))
    n_stated = F.size(stated)
    unstated = without(F.col("stated_facts"), stated)
    checks = [
        _check("geo-where", "geo", _status(where, FAIL), "Can AI answer “Where should I stay?”",
               F.when(where, _cat("A paragraph names ", brand, " with a concrete location fact.")).otherwise(_cat("No paragraph pairs ", brand, " with a concrete distance or location fact.")),
               _cat("Add a sentence like “", brand, " is a 5-minute walk from …”.")),
        _check("geo-why", "geo", _graded(n_stated, 2, 1), _cat("Can AI answer “Why choose ", brand, "?”"),
               _cat(n_stated, " approved fact", _s(n_stated), "/USP", _s(n_stated), " stated in the content."),
               F.when(F.size("stated_facts") > 0, _cat("Work in: ", F.array_join(F.slice(unstated, 1, 2), "; "), ".")).otherwise("Add approved facts to the brand profile first."), stated),
        let(for_aud, lambda ok: F.when(aud.isNotNull(), _check("geo-audience", "geo", _status(ok, WARN), _cat("Can AI answer “Best option for ", aud_label, "?”"),
               F.when(ok, _cat(brand, " is linked to ", aud_label, " in the same paragraph.")).otherwise(_cat("Nothing ties ", brand, " to ", aud_label, ".")),
               _cat("Say plainly why ", brand, " suits ", aud_label, ", with a fact.")))),
        _check("geo-entity", "geo", _status(early, WARN), "Brand + location in the first 100 words",
               F.when(early, "Strong entity association early on.").otherwise(_cat("Mention ", brand, F.when(has_city, _cat(" and ", F.col("city"))).otherwise(""), " in the opening.")),
               F.when(~early, "Name the brand and the destination in the intro.")),
        _check("geo-faq", "geo", _graded(asks, 2, 1), "Question-led sections / FAQ", _cat(asks, " question-style heading", _s(asks), "."),
               F.when(asks < 2, "Add an FAQ with the questions customers actually ask.")),
        _check("geo-quotable", "geo", _graded(quotable, 2, 1), "Quotable fact sentences", _cat(quotable, " short sentence", _s(quotable), " pairing ", brand, " with a number."),
               F.when(quotable < 2, "AI answers quote short, specific sentences: brand + fact + number.")),
    ]
    return metrics, checks if lexicon.audience else [c for i, c in enumerate(checks) if i != 2]


def unverified_figures(r: Reader) -> Column:
    """Figures in sentences about the brand that the approved facts do not contain."""
    def claims(s: Column) -> Column:
        whole = F.regexp_extract_all(s["sent_views"], F.lit("(?i)" + V.FIGURE.replace("\\s", V.WS_CLASS)), F.lit(0))
        number = F.regexp_extract_all(s["sent_views"], F.lit("(?i)" + V.FIGURE.replace("\\s", V.WS_CLASS)), F.lit(1))
        open_ = F.filter(F.arrays_zip(whole.alias("w"), number.alias("n")), lambda m: ~F.contains(r("fact_text"), F.replace(m["n"], F.lit(","), F.lit(""))))
        return F.transform(open_, lambda m: _cat(m["w"], " — “", ellipsis(s["sents"], 110, 107), "”"))

    about = F.filter(
        F.arrays_zip(r("sents"), r("sent_folds"), "sent_views"),
        lambda s: s["sents"].rlike("[0-9]")
        & (_names_any(s["sent_folds"], r("brand_phrases")) | matches(s["sent_views"], V.FIRST_PERSON, ignore_case=True)),
    )
    return F.flatten(F.transform(about, claims))


def other_spellings(r: Reader) -> Column:
    uk = F.coalesce(fold(F.coalesce(r("english_variant"), F.lit(V.DEFAULT_ENGLISH))).rlike(V.UK_VARIANTS), F.lit(False))

    def used(words: list[str]) -> Column:
        any_of = matches(r("plain_view"), r"\b(" + "|".join(words) + r")(s|ed|ing)?\b", ignore_case=True)
        each = F.array_compact(F.array(*[F.when(matches(r("plain_view"), rf"\b{w}(s|ed|ing)?\b", ignore_case=True), F.lit(w)) for w in words]))
        return F.when(any_of, each).otherwise(empty_array())

    return F.when(uk, used([us for us, _ in V.SPELLING_PAIRS])).otherwise(used([gb for _, gb in V.SPELLING_PAIRS]))


def _brand(lexicon: Lexicon, r: Reader) -> Area:
    text = r("plain_fold")

    def present(phrases: Column) -> Column:
        return F.filter(phrases, lambda p: folded_contains(text, fold_phrase(p)))

    def proof(p: Column) -> Column:
        stating = F.filter(F.arrays_zip(r("sents"), r("sent_folds")), lambda s: folded_contains(s["sent_folds"], fold_phrase(p)))
        return F.transform(F.slice(stating, 1, 1), lambda s: s["sents"])

    uk = fold(F.coalesce(r("english_variant"), F.lit(V.DEFAULT_ENGLISH))).rlike(V.UK_VARIANTS)
    tokens = (r("name_tokens"), r("name_folds"), r("name_ends"))
    metrics = {
        "claims": present(r("restricted")),
        "avoid": F.array_distinct(present(r("avoid"))),
        "used": present(r("preferred")),
        "rivals": F.transform(
            F.filter(F.arrays_zip(r("competitors"), r("rival_phrases")), lambda c: _names_any(text, c["rival_phrases"])), lambda c: c["competitors"]["name"]
        ),
        "issues": F.concat(
            name_variants(r("brand_name"), r("brand_aliases"), "Brand", *tokens),
            F.flatten(F.transform(r("competitors"), lambda c: name_variants(c["name"], c["aliases"], "Competitor", *tokens))),
        ),
        "figures": unverified_figures(r),
        "wrong": other_spellings(r),
    }
    claims, avoid, used, rivals, issues, figures, wrong = (_m(n) for n in metrics)
    restricted, preferred = F.col("restricted"), F.col("preferred")
    variant = F.coalesce(F.nullif("english_variant", F.lit("")), F.lit(V.DEFAULT_ENGLISH))

    def none(a: Column) -> Column:
        return F.size(a) == 0

    return metrics, [
        _check("brand-claims", "brand", _status(none(claims), FAIL), "Restricted claims",
               F.when(~none(claims), _cat("Content makes restricted claims: ", F.array_join(claims, ", "), "."))
               .when(~none(restricted), _cat("None of ", F.size(restricted), " restricted claims found.")).otherwise("No restricted claims configured."),
               F.when(~none(claims), "Remove or rephrase these claims."), F.flatten(F.transform(claims, proof))),
        _check("brand-avoid", "brand", _status(none(avoid), FAIL), "Words to avoid & feedback rules",
               F.when(~none(avoid), _cat("Found: ", F.array_join(F.transform(avoid, lambda w: _cat("“", w, "”")), ", "), ".")).otherwise("No banned words or phrases."),
               F.when(~none(avoid), "Replace with approved vocabulary.")),
        F.when(~none(preferred), _check("brand-vocab", "brand", _status(~none(used), WARN), "Preferred vocabulary",
               _cat(F.size(used), "/", F.size(preferred), " preferred phrases used."), F.when(none(used), _cat("Try: ", F.array_join(F.slice(preferred, 1, 3), ", "), ".")))),
        _check("brand-names", "brand", _status(none(issues), FAIL), "Brand & competitor spelling",
               F.when(~none(issues), F.array_join(F.array_distinct(issues), "; ")).otherwise("Names are spelled correctly."), F.when(~none(issues), "Use the exact official names.")),
        _check("brand-competitors", "brand", _status(none(rivals), WARN), "Competitor mentions",
               F.when(~none(rivals), _cat("Mentions ", F.array_join(rivals, ", "), ".")).otherwise("No competitors mentioned."),
               F.when(~none(rivals), "Only mention competitors for destination context; keep the brand as the main solution.")),
        _check("brand-figures", "brand", _status(none(figures), WARN), "Figures match approved facts",
               F.when(~none(figures), _cat(F.size(figures), " figure", _s(F.size(figures)), " not found in approved facts.")).otherwise("Every brand figure matches the approved facts."),
               F.when(~none(figures), "Check these against the fact sheet or remove them."), F.slice(figures, 1, 6)),
        _check("brand-english", "brand", _status(none(wrong), WARN), _cat(variant, " spelling"),
               F.when(~none(wrong), _cat("Other-variant spellings: ", F.array_join(wrong, ", "), ".")).otherwise("Spelling matches the brand variant."),
               F.when(~none(wrong), _cat("Switch to ", F.when(uk, "British").otherwise("American"), " spelling."))),
    ]


def _conversion(lexicon: Lexicon, r: Reader) -> Area:
    def calls(v: Column) -> Column:
        return matches(v, V.CALL_TO_ACTION, ignore_case=True)

    views = r("sent_views")
    start = F.floor(F.size(views) * F.lit(0.75)).cast("int")
    tail = F.array_join(F.slice(views, start + 1, F.greatest(F.size(views) - start, F.lit(0))), " ")
    metrics = {
        "calls": F.size(F.filter(views, calls)),
        "like_pref": _any(r("sent_words"), lambda s: share_within(r("cta_words"), s) >= 0.6),
        "closes": calls(tail),
        "booking": _any(r("links"), lambda l: F.concat_ws(" ", l["url"], l["text"]).rlike("(?i)" + V.BOOKING_LINK)),
    }
    n, like_pref, closes, booking = (_m(x) for x in metrics)
    pref = F.col("cta_preference")
    set_ = F.coalesce(pref, F.lit("")) != ""
    return metrics, [
        _check("cta", "conversion", _status(n > 0, FAIL), "Call to action", F.when(n > 0, _cat(n, " CTA", _s(n), " found.")).otherwise("No call to action."),
               F.when((n == 0) & set_, _cat("Add the preferred CTA: ", pref, ".")).when(n == 0, "End with one clear next step.")),
        F.when(set_, _check("cta-pref", "conversion", _status(like_pref, WARN), "Preferred CTA wording",
               F.when(like_pref, "Uses the brand's preferred CTA.").otherwise(_cat("Preferred: “", pref, "”.")))),
        _check("cta-end", "conversion", _status(closes, WARN), "CTA near the end", F.when(closes, "The piece closes with a next step.").otherwise("The ending has no next step."),
               F.when(~closes, "Close with a CTA.")),
        _check("cta-link", "conversion", _status(booking, WARN), "Link to rooms / booking / offers",
               F.when(booking, "Links to a conversion page.").otherwise("No link to rooms, offers or booking."), F.when(~booking, "Link the CTA to the booking or rooms page.")),
    ]


_AREAS = {"seo": _seo, "geo": _geo, "brand": _brand, "conversion": _conversion}


def check_drafts(
    drafts: DataFrame,
    brands: DataFrame,
    rules: DataFrame | None = None,
    lexicon: Lexicon = HOSPITALITY,
    areas: tuple[str, ...] = ("seo", "geo", "brand", "conversion"),
) -> DataFrame:
    """One row per draft and check: draft_id, check_id, area, status, label, detail,
    fix, evidence, word_count, keyword."""
    d = draft_features(drafts, brands, rules, lexicon)
    makers = [_AREAS[a] for a in areas]
    read: dict[str, None] = {}  # features the metrics of these areas read; the others are not computed

    def noted(name: str) -> Column:
        read[name] = None
        return F.col(name)

    for make in makers:
        make(lexicon, noted)
    features = F.struct(*read)

    def measured(row: Column) -> Column:
        found = {k: v for make in makers for k, v in make(lexicon, lambda c: row[c])[0].items()}
        return F.struct(*[v.alias("m_" + k) for k, v in found.items()])

    d = d.withColumn("m", let(features, measured)).select("*", "m.*")
    checks = [c for make in makers for c in make(lexicon, F.col)[1]]
    listed = d.select("draft_id", "project_id", "keyword", F.col("wc").alias("word_count"), F.array_compact(F.array(*checks)).alias("checks"))
    return listed.select("draft_id", "project_id", "keyword", "word_count", F.posexplode_outer("checks").alias("pos", "c")).select(
        "draft_id", "project_id", "keyword", "word_count", "pos", F.col("c.id").alias("check_id"), "c.area", "c.status", "c.label", "c.detail", "c.fix", "c.evidence"
    )


def score_drafts(checks: DataFrame) -> DataFrame:
    """Area scores and the weighted overall score per draft."""
    worth = F.when(F.col("status") == PASS, 1.0).when(F.col("status") == WARN, 0.5).otherwise(0.0)
    means = checks.groupBy("draft_id").agg(
        *[F.avg(F.when(F.col("area") == a, worth)).alias(a) for a, _ in V.AREA_WEIGHTS]
    )
    scores = means.select("draft_id", *[F.coalesce(js_round(F.col(a) * 100), F.lit(100)).cast("long").alias(a) for a, _ in V.AREA_WEIGHTS])
    total = sum((F.col(a) * F.lit(w) for a, w in V.AREA_WEIGHTS[1:]), F.col(V.AREA_WEIGHTS[0][0]) * F.lit(V.AREA_WEIGHTS[0][1]))
    return scores.withColumn("overall", js_round(total))


def failed_checks(checks: DataFrame, areas: tuple[str, ...] = ()) -> DataFrame:
    """Digest text of the checks a draft does not pass, and their number for each of ``areas``."""
    line = F.concat(F.lit("- ["), "area", F.lit("] "), "label", F.lit(": "), "detail", F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit(" Fix: "), "fix")).otherwise(""))
    open_ = checks.filter(F.col("status") != PASS).select("draft_id", "area", "pos", line.alias("line"))
    return open_.groupBy("draft_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("issues"),
        *[F.count_if(F.col("area") == a).alias(a) for a in areas],
    )


def checks_in_order(checks: DataFrame) -> DataFrame:
    """Failures first, then warnings, then passes: the ``place`` of each check within its draft
    and area, from 1. An area has a fixed number of checks, so no group of the window grows."""
    rank = F.array_position(F.array(F.lit(FAIL), F.lit(WARN), F.lit(PASS)), F.col("status"))
    return checks.withColumn("place", F.row_number().over(Window.partitionBy("draft_id", "area").orderBy(rank, "pos")))
