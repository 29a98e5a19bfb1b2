"""SQL fragments for the oracle queries (independent re-statements in DuckDB SQL)."""

from __future__ import annotations

from brandloom import vocab as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(values) -> str:
    return ", ".join(q(v) for v in values)


WS = V.WS_CLASS


def fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'd'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def words(folded: str) -> str:
    return f"regexp_extract_all({folded}, {q(chr(91) + 'a-z0-9]+(?:' + chr(39) + '[a-z]+)?')})"


def content(ws: str) -> str:
    return f"list_filter({ws}, lambda w: length(w) > 2 AND w NOT IN ({strs(V.STOPWORDS)}))"


def content_words(x: str) -> str:
    return content(words(fold(x)))


def sentences(x: str) -> str:
    spaced = f"regexp_replace({x}, '\\n+', ' ' || chr(10) || ' ', 'g')"
    cut = f"regexp_replace({spaced}, {q(f'([.!?]){WS}+')}, '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(10)), lambda s: {trim('s')}), lambda s: length(s) > 1)"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda p: {trim('p')}), lambda p: p <> '')"


def norm(x: str) -> str:
    f = f"replace({fold(x)}, '&', ' and ')"
    f = f"regexp_replace({f}, '[^a-z0-9 ]+', ' ', 'g')"
    f = f"regexp_replace({f}, '\\b({'|'.join(V.NAME_STOP_NOUNS)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({f}, ' +', ' ', 'g'))"


def same(a: str, b: str) -> str:
    """Same-business test on two normalised names."""
    return (
        f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (least(length({a}), length({b})) >= 5 AND "
        f"CASE WHEN length({a}) <= length({b}) THEN starts_with({b}, {a} || ' ') ELSE starts_with({a}, {b} || ' ') END)))"
    )


def topics(folded: str, lexicon) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({folded}, {q(t.pattern)}) THEN {q(t.id)} END" for t in lexicon.topics)
    return f"list_filter([{tests}], lambda t: t IS NOT NULL)"


def label(topic: str, lexicon) -> str:
    return f"CASE {topic} " + " ".join(f"WHEN {q(t.id)} THEN {q(t.label)}" for t in lexicon.topics) + " END"


def topic_format(topic: str, lexicon) -> str:
    return f"CASE {topic} " + " ".join(f"WHEN {q(t.id)} THEN {q(t.format or V.DEFAULT_GAP_FORMAT)}" for t in lexicon.topics) + " END"


def phrase(folded_text: str, phrase_: str) -> str:
    """Whole-phrase test for a phrase given as a Python string (letters and spaces)."""
    return f"regexp_matches({folded_text}, {q('(?:^|[^a-z0-9])' + phrase_ + '(?:[^a-z0-9]|$)')})"


def host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


def domain(url: str) -> str:
    plain = f"regexp_replace(string_split(regexp_replace({url}, '^https?://', ''), '/')[1], '^www\\.', '')"
    return f"CASE WHEN {host(url)} <> '' THEN {host(url)} ELSE {plain} END"


def join(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {q(sep)}), '')"


def overlap_share(needles: str, hay: str) -> str:
    return f"CASE WHEN len({needles}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({needles}, lambda w: list_contains({hay}, w)))::DOUBLE / len({needles}) END"


GSC = """
gsc AS (
  SELECT ord, CASE ord % 5 WHEN 0 THEN 'how to fit ' WHEN 1 THEN 'best ' WHEN 2 THEN 'near ' ELSE '' END || p_name || ' ' || lower(p_type)
         || CASE WHEN ord % 7 = 0 THEN ' vs blue gear' ELSE '' END AS query,
         CASE WHEN ord % 3 > 0 THEN p_brand END AS page, clicks, impressions, 1.0::DOUBLE + (ord % 400)::DOUBLE / 10.0::DOUBLE AS position
  FROM (SELECT p_name, p_type, p_brand, min(p_partkey) AS ord, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END)::BIGINT AS clicks,
               sum(CAST(l_quantity AS BIGINT))::BIGINT AS impressions
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_type, p_brand)
)"""


def ctr_curve(pos: str) -> str:
    slot = " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(V.CTR_CURVE, 1))
    return (
        f"CASE WHEN {pos} <= 10 THEN CASE least(greatest(floor({pos} + 0.5)::INT, 1), 10) {slot} END "
        f"WHEN {pos} <= 20 THEN {V.CTR_SECOND_PAGE}::DOUBLE ELSE {V.CTR_BEYOND}::DOUBLE END"
    )


def opportunities() -> str:
    """CTEs gsc and opps: the classified search queries."""
    rival = "(contains(nq, 'blue gear') OR contains(nq, 'blue gears') OR contains(nq, 'hot anvil'))"
    own = "(contains(nq, 'red widget') OR contains(nq, 'red widgets'))"
    rules = [
        (rival, "competitor name"),
        (f"NOT {rival} AND cmp", "comparison intent"),
        (f"NOT {rival} AND NOT cmp AND {own}", "branded"),
        ("ask", "question"),
        ("loc", "local modifier"),
        ("position >= 4 AND position <= 20", "striking distance"),
        (f"impressions >= 50 AND position <= 10 AND ctr < ({ctr_curve('position')}) * 0.6::DOUBLE", "low CTR for position"),
        ("impressions >= 20 AND position > 20", "content gap (ranks beyond page 2)"),
    ]
    signals = ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for t, n in rules)
    return f"""{GSC},
feat AS (
  SELECT *, {norm('query')} AS nq, regexp_matches(lower(query), {q(V.GSC_COMPARISON)}) AS cmp, regexp_matches(lower(query), {q(V.GSC_QUESTION)}) AS ask,
         regexp_matches(lower(query), {q(V.GSC_LOCAL)}) AS loc, CASE WHEN impressions <> 0 THEN clicks::DOUBLE / impressions ELSE 0.0::DOUBLE END AS ctr
  FROM gsc
),
graded AS (
  SELECT *, CASE WHEN {rival} OR cmp THEN 'competitors' WHEN {own} THEN 'company' ELSE 'customers' END AS pillar,
         list_filter([{signals}], lambda s: s IS NOT NULL) AS signals,
         CASE WHEN len(string_split_regex(trim(query), '\\s+')) >= 4 THEN 'long' ELSE 'short' END AS tail
  FROM feat
),
opps AS (
  SELECT *, floor(greatest(0.0::DOUBLE, impressions * (({ctr_curve('least(position, 3.0::DOUBLE)')}) - ctr))
         + CASE WHEN ask THEN 5 ELSE 0 END + CASE WHEN pillar = 'competitors' THEN 5 ELSE 0 END + 0.5)::BIGINT AS score
  FROM graded
)"""
