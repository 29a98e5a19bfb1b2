"""Draft checks, scores and retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.text import paragraphs
from brandloom.operators import checks as C
from brandloom.operators import retrieval as R
from brandloom.operators.topics import top_rows
from brandloom.workload import data as D
from brandloom.workload import sqltext as S
from brandloom.workload.text_queries import CHUNKS

L = D.PROSE_WORDS


def _checks(spark, sf, *areas):
    return C.check_drafts(D.drafts(spark, sf), D.brands(spark), D.rules(spark), L, areas or ("seo", "geo", "brand", "conversion"))


def _statuses(df):
    return df.select("draft_id", "check_id", "status")


def seo_checks(spark, sf):
    return _checks(spark, sf, "seo").select("draft_id", "check_id", "status", "word_count")


def geo_checks(spark, sf):
    return _statuses(_checks(spark, sf, "geo"))


def brand_checks(spark, sf):
    return _statuses(_checks(spark, sf, "brand"))


def conversion_checks(spark, sf):
    return _statuses(_checks(spark, sf, "conversion"))


def draft_scores(spark, sf):
    return C.score_drafts(_checks(spark, sf))


def open_issues(spark, sf):
    """Issue digest length per draft and the number of open checks per area."""
    found = C.failed_checks(_checks(spark, sf, "seo", "conversion"), ("seo", "conversion"))
    return found.select("draft_id", "seo", "conversion", F.size(F.split("issues", "\n- ")).alias("lines"))


def ordered_checks(spark, sf):
    """Checks of each draft as a report lists them: failures, warnings, passes."""
    return C.checks_in_order(_checks(spark, sf, "seo", "conversion")).select("draft_id", "area", "place", "check_id")


def label_neighbours(spark, sf):
    """Nearest vectors to the mean vector of each label."""
    e = D.table(spark, sf, "embeddings")
    dims = len(e.select("embedding").first()[0])
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dims)]).alias("embedding"))
    qs = mean.select(F.lit("all").alias("project_id"), F.col("label").alias("query_id"), "embedding")
    chunks = e.select(F.lit("all").alias("project_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    return R.vector_topk(qs, chunks, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_norm_profile(spark, sf):
    """Similarity of every vector to the mean vector of its own label."""
    e = D.table(spark, sf, "embeddings")
    dims = len(e.select("embedding").first()[0])
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dims)]).alias("mean"))
    return e.join(mean, "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


def passage_search(spark, sf):
    """Best passages per test item by full text, in every language."""
    b = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), R.search_terms(F.array("text")).alias("terms"))
    none = F.lit("\0")  # documents without a language are one of their own
    chunks = D.chunks(spark, sf).withColumn("project_id", F.coalesce("project_id", none))
    top = R.text_topk(b, chunks, 5)
    return top.select(F.nullif("project_id", none).alias("project_id"), "request_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def retrieved_passages(spark, sf):
    """Retrieval per label over all documents: its mean vector first, its first eight test items
    as the text fallback; with the passages that were found."""
    e = D.table(spark, sf, "embeddings")
    dims = len(e.select("embedding").first()[0])
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dims)]).alias("embedding"))
    items = D.table(spark, sf, "benchmark").select((F.col("item_id") % 10).cast("int").alias("label"), "item_id", "text")
    items = top_rows(items, ["label"], ["item_id"], 8).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    asked = mean.join(items, "label").withColumn("embedding", F.when(F.col("label") % 2 == 0, F.col("embedding")))
    req = asked.select(
        F.lit("all").alias("project_id"), F.col("label").alias("request_id"),
        F.transform("texts", lambda t: F.struct(t.alias("text"), F.col("embedding").alias("embedding"))).alias("queries"),
    )
    d = D.table(spark, sf, "documents")
    chunks = d.join(e, d.doc_id == e.vec_id, "left").select(F.lit("all").alias("project_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "embedding")
    documents = d.select(F.lit("all").alias("project_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("lang").alias("category"))
    found = R.with_passages(R.retrieve(req, chunks), chunks, documents)
    return found.select("request_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank", "title", "category", F.md5("content").alias("content_md5"))


def draft_search_texts(spark, sf):
    """Query texts built from each draft for passage retrieval."""
    d = D.table(spark, sf, "documents")
    qs = R.draft_queries(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))
    return d.select("doc_id", F.size(qs).alias("n"), F.md5(F.array_join(qs, "|")).alias("texts_md5"))


QUERIES = {f.__name__: f for f in (
    seo_checks, geo_checks, brand_checks, conversion_checks, draft_scores, open_issues, ordered_checks, label_neighbours, vector_norm_profile, passage_search, retrieved_passages, draft_search_texts,
)}

_W = S.WS
_KW = f"array_to_string({S.content_words('text')}[1:2], ' ')"
_HM, _HT = f"(?m)^(#{{1,6}}){_W}+(.+)$", "(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), {S.q(f'(?m)^#{{1,6}}{_W}+')}, '', 'g'), '[*_`>]', '', 'g')"
_BRAND = ["orre orre", "the", "und"]


def _brand_in(x: str) -> str:
    return f"regexp_matches({x}, {S.q('(?:^|[^a-z0-9])(?:' + '|'.join(_BRAND) + ')(?:[^a-z0-9]|$)')})"


def _has(phrases: list[str]) -> str:
    return " OR ".join(S.phrase("pf", p) for p in phrases)


DRAFTS = f"""keyed AS (SELECT *, CASE WHEN doc_id % 10 > 0 THEN {_KW} END AS kw FROM documents),
drafts AS (SELECT doc_id AS draft_id, nullif(kw, '') AS kw, '# ' || coalesce('Is ' || kw, 'none' || chr(10) || '### three') || chr(10) || chr(10) || text || chr(10) || '[' || CASE doc_id % 3 WHEN 0 THEN 'the book' WHEN 1 THEN 'see offers' ELSE 'a page' END
   || '](' || source || ') [x](/y)' || CASE WHEN doc_id % 2 = 0 THEN ' [y](/tion)' ELSE '' END AS content FROM keyed),
parsed AS (SELECT *, {_PLAIN} AS plain, list_concat(list_transform(regexp_extract_all(content, {S.q(_HM)}, 1), lambda h: length(h)::INT), list_transform(regexp_extract_all(content, {S.q(_HT)}, 1), lambda h: h::INT)) AS lv,
   list_concat(list_transform(regexp_extract_all(content, {S.q(_HM)}, 2), lambda t: {S.trim('t')}), list_transform(regexp_extract_all(content, {S.q(_HT)}, 2), lambda t: {S.trim("regexp_replace(t, '<[^>]+>', '', 'g')")})) AS tx,
   regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 2) AS urls, regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 1) AS anchors FROM drafts),
folded AS (SELECT *, {S.fold('plain')} AS pf, {S.sentences('plain')} AS ss, {S.paragraphs('plain')} AS ps, {S.content_words("coalesce(kw, '')")} AS kww FROM parsed),
feat AS (SELECT *, {S.words('pf')} AS wl, list_transform(ss, lambda s: {S.fold('s')}) AS sf, list_transform(ps, lambda s: {S.fold('s')}) AS pfs FROM folded),
d AS (SELECT *, len(wl)::INT AS wc, array_to_string(wl[1:100], ' ') AS f100, list_transform(sf, lambda s: {S.content(S.words('s'))}) AS sw FROM feat)"""


def _cover(x: str) -> str:
    return S.overlap_share("kww", S.content_words(x))


_H1 = "tx[list_position(lv, 1)]"
_TIMES = "len(string_split(pf, " + S.fold("kw") + ")) - 1"
_DENSITY = f"CASE WHEN wc > 0 THEN ({_TIMES})::DOUBLE * len(kww) / wc ELSE 0 END"
_SKIP = "coalesce(list_bool_or(list_transform(lv[2:], lambda x, i: x - lv[i] > 1)), false)"


def _n(level: int) -> str:
    return f"len(list_filter(lv, lambda x: x = {level}))"


def graded(x: str, good, fair) -> str:
    return f"CASE WHEN {x} >= {good} THEN 'pass' WHEN {x} >= {fair} THEN 'warn' ELSE 'fail' END"


def _ok(x: str, other: str) -> str:
    return f"CASE WHEN {x} THEN 'pass' ELSE '{other}' END"


_MISS = "+".join(f"(CASE WHEN {S.phrase('pf', p)} THEN 0 ELSE 1 END)" for p in ("thing", "erer", "und der"))
SEO = [
    ("kw-h1", f"CASE WHEN kw IS NOT NULL THEN {_ok(f'list_position(lv, 1) IS NOT NULL AND ({_cover(_H1)}) >= 0.6::DOUBLE', 'fail')} END"),
    ("kw-intro", f"CASE WHEN kw IS NOT NULL THEN {_ok(f'({_cover(chr(102) + str(100))}) >= 0.75::DOUBLE', 'warn')} END"),
    ("kw-h2", f"CASE WHEN kw IS NOT NULL THEN {_ok(f'coalesce(list_bool_or(list_transform(tx, lambda t, i: lv[i] = 2 AND ({_cover(chr(116))}) >= 0.5::DOUBLE)), false)', 'warn')} END"),
    ("kw-density", f"CASE WHEN kw IS NOT NULL THEN CASE WHEN ({_DENSITY}) > 0.03::DOUBLE OR {_TIMES} = 0 THEN 'warn' ELSE 'pass' END END"),
    ("kw-none", "CASE WHEN kw IS NULL THEN 'warn' END"),
    ("headings", f"CASE WHEN {_n(1)} = 1 AND (wc < 400 OR {_n(2)} >= 2) AND NOT {_SKIP} THEN 'pass' WHEN {_n(1)} > 1 OR {_SKIP} THEN 'fail' ELSE 'warn' END"),
    ("length", graded("wc", 600, 300)),
    ("entities", graded(f"(1.0::DOUBLE - ({_MISS})::DOUBLE / 3)", "0.7::DOUBLE", "0.4::DOUBLE")),
    ("internal-links", graded("len(list_filter(urls, lambda u: starts_with(u, '/') OR ends_with(" + S.domain("u") + ", 'ththre.example.com')))", 2, 1)),
]
_FACT_WORDS = [["tion"], ["erin", "thble", "thsh"], ["und", "der", "die", "mit"], ["orre", "orre"]]
_STATED = " + ".join(
    f"(CASE WHEN coalesce(list_bool_or(list_transform(sw, lambda s: {S.overlap_share('[' + S.strs(w) + ']', 's')} >= 0.6::DOUBLE)), false) THEN 1 ELSE 0 END)" for w in _FACT_WORDS
)
_AUD = f"coalesce(list_filter({S.topics(S.fold(chr(107) + 'w'), L)}, lambda t: t IN ('company', 'past'))[1], 'company')"
_COMPANY, _PAST = (S.q(t.pattern) for t in L.topics[1:3])
_DIGIT = "regexp_matches(s, '[0-9]')"
GEO = [
    ("geo-where", _ok(f"coalesce(list_bool_or(list_transform(ps, lambda p, i: regexp_matches(p, {S.q('(?i)' + V.DISTANCE)}) AND {_brand_in('pfs[i]')})), false)", "fail")),
    ("geo-why", graded(f"({_STATED})", 2, 1)),
    ("geo-audience", _ok(f"coalesce(list_bool_or(list_transform(pfs, lambda p: {_brand_in('p')} AND CASE {_AUD} WHEN 'company' THEN regexp_matches(p, {_COMPANY}) ELSE regexp_matches(p, {_PAST}) END)), false)", "warn")),
    ("geo-entity", _ok(f"{_brand_in('f100')} AND {S.phrase('f100', 'th')}", "warn")),
    ("geo-faq", graded(f"len(list_filter(tx, lambda t: regexp_matches(t, {S.q('(?i)' + V.QUESTION_HEADING)})))", 2, 1)),
    ("geo-quotable", graded(f"len(list_filter(list_transform(ss, lambda s, i: {_DIGIT} AND len(string_split_regex(s, {S.q(_W + '+')})) <= 35 AND {_brand_in('sf[i]')}), lambda b: b))", 2, 1)),
]


def _variant(official: str, known: list[str]) -> str:
    f, size = official.lower(), len(official.split())
    gram = f"array_to_string(toks[i + 1:i + {size}], ' ')"
    g = S.fold(f"regexp_replace({gram}, '[.,;:!?)]+$', '')")
    return f"len(list_filter(list_transform(range(greatest(len(toks) - {size} + 1, 0)), lambda i: {g}), lambda g: g <> {S.q(f)} AND g NOT IN ({S.strs(known)}) AND abs(length(g) - {len(f)}) <= 1 AND levenshtein(g, {S.q(f)}) = 1)) > 0"


_NAMES = " OR ".join(_variant(o, k) for o, k in (("Orre Orre", ["the", "und"]), ("Sich Sich", ["der", "die"]), ("Thatin", [""]), ("Orantion", ["hehely"])))
_FACT_TEXT = S.fold(S.q("The from that with\nThis is from the tion; Erin and thble and thsh Und der die mit\nthe orre orre license pages"))
_FIG = S.q("(?i)" + V.FIGURE)
_UNVERIFIED = (
    f"len(flatten(list_transform(list_filter(list_transform(ss, lambda s, i: {{'s': s, 'f': sf[i]}}), lambda x: {_brand_in('x.f')} OR regexp_matches(x.s, {S.q('(?i)' + V.FIRST_PERSON)})),"
    f" lambda x: list_filter(regexp_extract_all(x.s, {_FIG}, 1), lambda n: NOT contains({_FACT_TEXT}, replace(n, ',', ''))))))"
)
BRAND = [
    ("brand-claims", f"CASE WHEN {_has(['thing', 'erer', 'ther'])} THEN 'fail' ELSE 'pass' END"),
    ("brand-avoid", f"CASE WHEN {_has(['thble', 'thsh', 'inoran', 'ononst', 'rewh', 'the of'])} THEN 'fail' ELSE 'pass' END"),
    ("brand-vocab", f"CASE WHEN {_has(['the', 'rewh', 'thing', 'hehely'])} THEN 'pass' ELSE 'warn' END"),
    ("brand-names", f"CASE WHEN {_NAMES} THEN 'fail' ELSE 'pass' END"),
    ("brand-competitors", f"CASE WHEN {_has(['sich sich', 'der', 'die', 'thatin', 'orantion', 'hehely'])} THEN 'warn' ELSE 'pass' END"),
    ("brand-figures", f"CASE WHEN {_UNVERIFIED} > 0 THEN 'warn' ELSE 'pass' END"),
    ("brand-english", f"CASE WHEN regexp_matches(plain, {S.q('(?i)' + chr(92) + 'b(' + '|'.join(b for _, b in V.SPELLING_PAIRS) + ')(s|ed|ing)?' + chr(92) + 'b')}) THEN 'warn' ELSE 'pass' END"),
]
_CTA = S.q("(?i)" + V.CALL_TO_ACTION)
CONVERSION = [
    ("cta", f"CASE WHEN coalesce(list_bool_or(list_transform(ss, lambda s: regexp_matches(s, {_CTA}))), false) THEN 'pass' ELSE 'fail' END"),
    ("cta-pref", f"CASE WHEN coalesce(list_bool_or(list_transform(sw, lambda s: {S.overlap_share('[' + S.strs(['thing', 'erer']) + ']', 's')} >= 0.6::DOUBLE)), false) THEN 'pass' ELSE 'warn' END"),
    ("cta-end", f"CASE WHEN regexp_matches(array_to_string(ss[floor(len(ss) * 0.75)::INT + 1:], ' '), {_CTA}) THEN 'pass' ELSE 'warn' END"),
    ("cta-link", f"CASE WHEN coalesce(list_bool_or(list_transform(urls, lambda u, i: regexp_matches(u || ' ' || anchors[i], {S.q('(?i)' + V.BOOKING_LINK)}))), false) THEN 'pass' ELSE 'warn' END"),
]


def check_rows(*groups, extra: str = "") -> str:
    items = ", ".join(f"{{'a': '{a}', 'c': '{c}', 's': {sql}}}" for a, g in groups for c, sql in g)
    toks = ", regexp_extract_all(plain, '[\\p{L}\\p{N}''’&.\\-]+') AS toks"
    return f"WITH {DRAFTS}, t AS (SELECT *{toks} FROM d), r AS (SELECT draft_id, wc, unnest([{items}]) AS x FROM t), checks AS (SELECT draft_id, wc, x.a AS area, x.c AS check_id, x.s AS status FROM r WHERE x.s IS NOT NULL)"


_WORTH = "avg(CASE status WHEN 'pass' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) FILTER (area = '{a}')"
_AREA = ", ".join(f"floor({_WORTH.format(a=a)} * 100 + 0.5)::BIGINT AS {a}" for a, _ in V.AREA_WEIGHTS)
_MEANS = "list_transform(range(64), lambda i: list_avg(list_transform(vs, lambda v: v[i + 1]::DOUBLE)))"
_MEAN = f"means AS (SELECT label, {_MEANS} AS m FROM (SELECT label, list(embedding) AS vs FROM embeddings GROUP BY label))"
_TERMS = f"list_filter(regexp_extract_all(strip_accents(lower({{}})), '[a-z0-9]{{{{3,}}}}'), lambda w: w NOT IN ({S.strs(V.QUERY_STOPWORDS)}))"


def terms(x: str) -> str:
    """First thirty distinct search words of a text, in order."""
    ws = _TERMS.format(x)
    return f"list_filter({ws}, lambda w, i: list_position({ws}, w) = i)[1:30]"


TOKENS = "tokens AS (SELECT project_id, chunk_id, token, count(*) AS n FROM (SELECT project_id, chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS token FROM chunks) GROUP BY ALL)"
_RANK = "sum(round(list_sum(list_transform(range(1, least(n, 256) + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685::DOUBLE * 1000000000000)::BIGINT)::DOUBLE / 1000000000000 / max(nt)"

ORACLES = {
    "seo_checks": f"{check_rows(('seo', SEO))} SELECT draft_id, check_id, status, wc AS word_count FROM checks",
    "geo_checks": f"{check_rows(('geo', GEO))} SELECT draft_id, check_id, status FROM checks",
    "brand_checks": f"{check_rows(('brand', BRAND))} SELECT draft_id, check_id, status FROM checks",
    "conversion_checks": f"{check_rows(('conversion', CONVERSION))} SELECT draft_id, check_id, status FROM checks",
    "draft_scores": f"""{check_rows(('seo', SEO), ('geo', GEO), ('brand', BRAND), ('conversion', CONVERSION))}, sc AS (SELECT draft_id, {_AREA} FROM checks GROUP BY draft_id)
        SELECT *, floor(seo * 0.3::DOUBLE + geo * 0.25::DOUBLE + brand * 0.3::DOUBLE + conversion * 0.15::DOUBLE + 0.5)::BIGINT AS overall FROM sc""",
    "open_issues": f"{check_rows(('seo', SEO), ('conversion', CONVERSION))} SELECT draft_id, count(*) FILTER (area = 'seo') AS seo, count(*) FILTER (area = 'conversion') AS conversion, count(*)::INT AS lines FROM checks WHERE status <> 'pass' GROUP BY draft_id",
    "ordered_checks": f"""{check_rows(('seo', SEO), ('conversion', CONVERSION))}, o AS (SELECT unnest([{S.strs([c for c, _ in SEO + CONVERSION])}]) AS check_id, unnest(range({len(SEO) + len(CONVERSION)})) AS pos)
        SELECT draft_id, area, row_number() OVER (PARTITION BY draft_id, area ORDER BY list_position(['fail', 'warn', 'pass'], status), pos)::INT AS place, check_id FROM checks JOIN o USING (check_id)""",
    "label_neighbours": f"""WITH {_MEAN}, s AS (SELECT label AS query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], m) AS sim FROM means, (SELECT vec_id, embedding FROM embeddings))
        SELECT query_id, chunk_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""",
    "vector_norm_profile": f"WITH {_MEAN} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) AS similarity FROM embeddings JOIN means USING (label)",
    "passage_search": f"""WITH {CHUNKS}, {TOKENS}, q AS (SELECT item_id AS request_id, {terms('text')} AS ts FROM benchmark), w AS (SELECT request_id, len(ts) AS nt, unnest(ts) AS token FROM q),
        s AS (SELECT project_id, request_id, chunk_id, {_RANK} AS sim FROM w JOIN tokens USING (token) GROUP BY ALL)
        SELECT project_id, request_id, chunk_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY project_id, request_id ORDER BY sim DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    "retrieved_passages": f"""WITH {_MEAN}, item AS (SELECT label, array_to_string(list(text ORDER BY item_id)[1:8], ' ') AS text FROM (SELECT (item_id % 10)::INT AS label, * FROM benchmark) GROUP BY 1),
        req AS (SELECT label, text, CASE WHEN label % 2 = 0 THEN m END AS m, {terms('text')} AS ts FROM means JOIN item USING (label)),
        chunks AS (SELECT 'all' AS project_id, doc_id AS chunk_id, text AS content, embedding, source, lang FROM documents LEFT JOIN embeddings ON doc_id = vec_id), {TOKENS},
        near AS (SELECT label, chunk_id, list_cosine_similarity(embedding::DOUBLE[], m) AS sim, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(embedding::DOUBLE[], m) DESC, chunk_id) AS r FROM req, chunks WHERE m IS NOT NULL AND embedding IS NOT NULL QUALIFY r <= 6),
        few AS (SELECT label, ts FROM req WHERE (SELECT count(*) FROM near n WHERE n.label = req.label) < 7),
        scored AS (SELECT label, chunk_id, {_RANK} AS sim FROM (SELECT label, len(ts) AS nt, unnest(ts) AS token FROM few) JOIN tokens USING (token) GROUP BY ALL),
        txt AS (SELECT label, chunk_id, least(sim, 0.5::DOUBLE) AS sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, chunk_id) AS r FROM scored QUALIFY r <= 14),
        merged AS (SELECT label, chunk_id, max(sim) AS sim, min(seen) AS seen FROM (SELECT label, chunk_id, sim, (0, r) AS seen FROM near UNION ALL SELECT label, chunk_id, sim, (8, r) FROM txt) GROUP BY ALL),
        best AS (SELECT label, chunk_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, seen, chunk_id)::INT AS rank FROM merged QUALIFY rank <= 14)
        SELECT label AS request_id, chunk_id, round(sim, 6) AS similarity, rank, source AS title, lang AS category, md5(content) AS content_md5 FROM best JOIN chunks USING (chunk_id)""",
    "draft_search_texts": f"""WITH p AS (SELECT doc_id, list_concat(['T' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' — ' || source ELSE '' END], list_transform(list_filter({S.paragraphs("replace(text, chr(10), chr(10) || chr(10))")}, lambda p: length(p) > 40)[1:7], lambda p: left(p, 600))) AS qs FROM documents)
        SELECT doc_id, len(qs)::INT AS n, md5(array_to_string(qs, '|')) AS texts_md5 FROM p""",
}
