"""Text kernel, page parsing, chunk and similarity queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions import search as X
from brandloom.functions import text as T
from brandloom.functions.names import normalize_name
from brandloom.operators.documents import corpus_budget, document_text
from brandloom.operators.names import first_match, same_business_join
from brandloom.operators.phrases import phrase_matches
from brandloom.operators.questions import similar_clusters, similar_pairs, word_set
from brandloom.workload import data as D
from brandloom.workload import sqltext as S


def text_profile(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("folded", T.fold(F.col("text")))
    d = d.withColumn("ws", T.words_of(F.col("folded")))
    return d.select(
        "doc_id", F.md5("folded").alias("fold_md5"), F.size("ws").alias("n_words"), F.size(T.drop_stopwords(F.col("ws"))).alias("n_content_words"),
        F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"),
        F.size(T.lines(F.col("text"))).alias("n_lines"), F.length(T.clean_text(F.col("text"))).alias("n_clean"), F.md5(T.ellipsis(F.col("text"), 160, 157)).alias("short_md5"),
    )


def normalized_names(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" Hôtel & Spa, the "), F.lower("p_type")).alias("n"))
    return p.select("p_partkey", normalize_name(F.col("n")).alias("norm"))


def page_headlines(spark, sf):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return D.table(spark, sf, "pages").select("page_id", T.title_case(T.decode_entities(t)).alias("headline"))


def page_domains(spark, sf):
    p = D.table(spark, sf, "pages").withColumn("domain", T.domain_of(F.col("url"))).withColumn("stripped", T.domain_of(F.regexp_replace("url", "^https?://", "")))
    kind = X.domain_kind(F.col("domain"), F.lit("ththre.example.com"), F.array(F.lit("therin.example.net"), F.lit("spam-farm.example.org")))
    return p.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.min(kind).alias("kind"), F.count_if(F.col("stripped") == F.col("domain")).alias("same_without_scheme"), F.min(T.citation_domain(F.col("url"))).alias("cited"))


def page_structure(spark, sf):
    h, l = X.headings(F.col("html")), X.links(F.col("html"))
    p = D.table(spark, sf, "pages").select("page_id", h.alias("h"), l.alias("l"), X.plain_text(F.col("html")).alias("plain"))
    first = F.get("h", F.lit(0))
    return p.select(
        "page_id", F.size("h").alias("n_headings"), F.md5(first["text"]).alias("h1_md5"), first["level"].alias("level"), F.size("l").alias("n_links"),
        F.get("l", F.lit(0))["url"].alias("first_url"), F.size(T.words(F.col("plain"))).alias("n_words"), X.skipped_level(F.col("h")).cast("int").alias("skipped"),
    )


def page_text(spark, sf):
    """Web pages ingested as brand documents: tags removed, white space cleaned."""
    p = D.table(spark, sf, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, ".doc").when(F.col("page_id") % 7 == 0, ".xyz").otherwise(".html"))
    docs = p.select(F.col("page_id").alias("document_id"), F.lit("x").alias("project_id"), name.alias("name"), F.col("html").alias("text"))
    out = document_text(docs)
    return out.select("document_id", "status", "error", F.md5(F.coalesce("content", F.lit(""))).alias("text_md5"))


def document_chunks(spark, sf):
    return D.chunks(spark, sf).select("document_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def corpus_excerpts(spark, sf):
    d = D.table(spark, sf, "documents").select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 9 == 0, "error").otherwise("ready").alias("status"), F.col("doc_id").alias("created_at"),
    )
    return corpus_budget(d, 2_500, 9_000).select("project_id", "document_id", "rank", "taken", F.md5("excerpt").alias("excerpt_md5"))


def same_business_pairs(spark, sf):
    """Part names against longer catalogue names; copies are counted, then matched."""
    p = D.table(spark, sf, "part")
    a = p.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    b = p.groupBy(F.concat(F.lit("The "), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" hotel")).alias("listed")).agg(F.count(F.lit(1)).alias("m")).withColumn("k", F.lit(1))
    return same_business_join(a, b, "name", "listed", ["k"]).select("name", "listed", "n", "m")


def first_listed_part(spark, sf):
    """For every part name of a brand, the first larger part it is listed under."""
    p = D.table(spark, sf, "part")
    names = p.select("p_brand", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"))
    targets = p.filter(F.col("p_size") >= 10).select("p_brand", F.concat("p_name", F.when(F.col("p_size") > 30, F.concat(F.lit(" "), F.lower("p_type"), F.lit(" spa"))).otherwise("")).alias("title"), F.col("p_partkey").alias("ord"), "p_retailprice")
    return first_match(names, targets, "name", "title", ["p_brand"], ["ord"], ["ord", "p_retailprice"])


def similar_documents(spark, sf):
    """Each document with the first document like it that leads a group."""
    d = D.table(spark, sf, "documents").select("doc_id", word_set(F.col("text")).alias("ws"))
    p = similar_clusters(d, "doc_id", "ws", 0.5)
    return p.select(F.col("member").alias("doc_id"), F.col("leader").alias("leader_id"), F.round("similarity", 6).alias("similarity"), F.col("size").alias("group_size"))


def benchmark_overlap(spark, sf):
    """Test-set items against the documents they resemble."""
    items = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), word_set(F.col("text")).alias("ws"))
    paras = D.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    docs = paras.select((F.col("doc_id") * 10_000 + F.col("pos")).alias("id"), word_set(F.col("p")).alias("ws"))
    return similar_pairs(items, "id", "ws", 0.4, against=docs).select("id_a", "id_b", "copies_a", "copies_b", F.round("similarity", 6).alias("similarity"))


def topic_mentions(spark, sf):
    d = D.table(spark, sf, "documents")
    t = D.PROSE_WORDS.topics_in(F.col("text"))
    d = d.select("doc_id", t.alias("ts"))
    return d.select("doc_id", F.array_join("ts", "|").alias("topics"), D.PROSE_WORDS.primary_of(F.col("ts")).alias("primary_topic"), F.array_join(D.PROSE_WORDS.audience_of(F.col("ts")), "|").alias("audience"))


def topic_table_matches(spark, sf):
    """The lexicon as a joined dimension table: texts per topic and language."""
    topics = D.PROSE_WORDS.topics_in(F.col("text"))
    found = D.table(spark, sf, "documents").select("lang", F.explode(topics).alias("topic_id")).groupBy("lang", "topic_id").agg(F.count(F.lit(1)).alias("texts"))
    return found.join(D.PROSE_WORDS.table(spark), "topic_id").select("topic_id", "label", "lang", "texts")


def phrase_table_matches(spark, sf):
    """Beginnings of the benchmark items as a table of phrases: documents that hold them, for each item."""
    ws = T.words(F.col("text"))
    begins = F.array(*[F.array_join(F.slice("ws", 1, n), " ") for n in (1, 2, 3, 5, 8)])
    phrases = D.table(spark, sf, "benchmark").select("item_id", ws.alias("ws")).select(F.col("item_id").alias("topic_id"), F.explode(begins).alias("phrase"))
    hits = phrase_matches(D.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", phrases, ["topic_id"])
    return hits.groupBy("topic_id", "phrase").agg(F.count(F.lit(1)).alias("texts"))


def phrase_hits(spark, sf):
    """Documents that hold a whole phrase, per language."""
    d = D.table(spark, sf, "documents").withColumn("f", T.fold(F.col("text")))
    phrases = ["of the", "The Thing", "les", "und der", "apache license"]
    return d.groupBy("lang").agg(*[F.count_if(T.folded_contains(F.col("f"), T.fold_phrase(F.lit(p)))).alias("p_" + p.lower().replace(" ", "_")) for p in phrases])


def rule_phrases(spark, sf):
    """Banned phrases and claims mined from rule texts built from part names."""
    p = D.table(spark, sf, "part")
    rule = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Never call us a "), "p_name", F.lit(".")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('Avoid "'), "p_name", F.lit('" and “'), F.lower("p_type"), F.lit("”")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Cannot claim the "), "p_name", F.lit("..")))
        .otherwise(F.concat(F.lit('Say "'), "p_name", F.lit('"')))
    )
    return p.select("p_partkey", F.array_join(X.banned_from_rules(F.array(rule)), "|").alias("banned"), X.claim_phrase(rule).alias("claim"))


QUERIES = {f.__name__: f for f in (
    text_profile, normalized_names, page_headlines, page_domains, page_structure, page_text, document_chunks, corpus_excerpts, same_business_pairs,
    first_listed_part, similar_documents, benchmark_overlap, topic_mentions, topic_table_matches, phrase_table_matches, phrase_hits, rule_phrases,
)}

_BULLET = f"(?i)^[{V.WS_CLASS[1:-1]}\\-•*✓✔❌✗x]+"
_LINES = f"list_filter(list_transform(string_split_regex(text, '\\n|;'), lambda l: {S.trim(f'regexp_replace(l, {S.q(_BULLET)}, {S.q(str())})')}), lambda l: length(l) > 1)"
_CLEAN = S.trim("regexp_replace(regexp_replace(replace({0}, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _clean(x: str) -> str:
    return _CLEAN.replace("{0}", x).replace("{{", "{").replace("}}", "}")


_TITLE = "replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')"
_TOKENS = f"regexp_extract_all(t, {S.q(f'{V.WS_CLASS}+|[^{V.WS_CLASS[1:-1]}]+')})"
_HEADINGS = " || ".join(
    ["list_transform(regexp_extract_all(html, '(?m)^(#{1,6})\\s+(.+)$', 1), lambda x, i: {'p': 0, 'level': length(x), 'text': regexp_extract_all(html, '(?m)^(#{1,6})\\s+(.+)$', 2)[i]})"]
)
_H1 = "regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', {})"
_LINK = "regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 1)"
_MDLINK = "regexp_extract_all(html, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 2)"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '(?m)^#{1,6}\\s+', '', 'g'), '[*_`>]', '', 'g')"

_CHUNK_SEP = "chr(30)"
# State of the fold: finished chunks and the open one, separated by chr(30).
_OPEN = "split_part(acc, chr(30), -1)"
_DONE = f"left(acc, length(acc) - length({_OPEN}))"
_SLICES = "array_to_string(list_transform(range(0, length(p), 1050), lambda i: substr(p, i + 1, 1200)), chr(30))"
_STEP = f"""CASE WHEN length(p) > 1200 THEN {_DONE} || CASE WHEN {_OPEN} <> '' THEN {_OPEN} || chr(30) ELSE '' END || {_SLICES} || chr(30)
  WHEN {_OPEN} <> '' AND length({_OPEN}) + 2 + length(p) > 1200 THEN acc || chr(30) || right({_OPEN}, 150) || chr(10) || chr(10) || p
  ELSE acc || CASE WHEN {_OPEN} <> '' THEN chr(10) || chr(10) ELSE '' END || p END"""
CHUNKS = f"""chunked AS (SELECT doc_id AS document_id, lang, list_filter(string_split(list_reduce(list_concat([''], {S.paragraphs('text')}), lambda acc, p: {_STEP}), chr(30)), lambda c: c <> '') AS cs FROM documents),
chunks AS (SELECT document_id, lang AS project_id, i::INT AS chunk_index, cs[i + 1] AS content, document_id * 10000 + i AS chunk_id FROM (SELECT *, unnest(range(len(cs))) AS i FROM chunked))"""

_WORDSET = "list_sort(list_distinct({}))"


def _jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


_RULE = """CASE p_partkey % 4 WHEN 0 THEN 'Never call us a ' || p_name || '.' WHEN 1 THEN 'Avoid "' || p_name || '" and “' || lower(p_type) || '”' WHEN 2 THEN 'Cannot claim the ' || p_name || '..' ELSE 'Say "' || p_name || '"' END"""
_CLAIM = "r"
for _p in V.CLAIM_PREFIXES:
    _CLAIM = f"regexp_replace({_CLAIM}, {S.q('(?i)' + _p)}, '')"
_CLAIM = f"trim(regexp_replace({_CLAIM}, '[.]+$', ''))"
_TL = f"{S.topics('f', D.PROSE_WORDS)}"

ORACLES = {
    "text_profile": f"""SELECT doc_id, md5({S.fold('text')}) AS fold_md5, len({S.words(S.fold('text'))})::INT AS n_words, len({S.content_words('text')})::INT AS n_content_words,
        len({S.sentences('text')})::INT AS n_sentences, len({S.paragraphs('text')})::INT AS n_paragraphs, len({_LINES})::INT AS n_lines, length({_clean('text')})::INT AS n_clean,
        md5(CASE WHEN length(text) > 160 THEN left(text, 157) || '…' ELSE text END) AS short_md5 FROM documents""",
    "normalized_names": f"SELECT p_partkey, {S.norm('n')} AS norm FROM (SELECT p_partkey, p_name || ' Hôtel & Spa, the ' || lower(p_type) AS n FROM part)",
    "page_headlines": f"""SELECT page_id, array_to_string(list_transform({_TOKENS}, lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({S.strs(V.TITLE_SMALL_WORDS)}) THEN lower(w)
        WHEN regexp_matches(w[1], '\\p{{L}}') THEN replace(upper(w[1]), 'ẞ', 'SS') || w[2:] ELSE w END), '') AS headline FROM (SELECT page_id, {_TITLE} AS t FROM pages)""",
    "page_domains": f"""SELECT domain, count(*) AS pages, min(CASE WHEN domain LIKE '%ththre.example.com' THEN 'brand site' WHEN regexp_matches(domain, {S.q(V.CITATION_OTA_DOMAINS)}) THEN 'OTA'
        WHEN regexp_matches(domain, {S.q(V.CITATION_REVIEW_DOMAINS)}) THEN 'reviews / maps' WHEN regexp_matches(domain, {S.q(V.CITATION_FORUM_DOMAINS)}) THEN 'forum'
        WHEN domain LIKE '%therin.example.net' OR domain LIKE '%spam-farm.example.org' THEN 'competitor site' ELSE 'editorial / other' END) AS kind,
        count(*) FILTER (domain = regexp_replace(string_split(regexp_replace(url, '^https?://', ''), '/')[1], '^www\\.', '')) AS same_without_scheme, min(domain) AS cited
        FROM (SELECT url, {S.domain('url')} AS domain FROM pages) GROUP BY domain""",
    "page_structure": f"""WITH b AS (SELECT *, regexp_extract_all(html, '(?m)^(#{{1,6}})\\s+(.+)$', 1) AS mh, regexp_extract_all(html, '(?m)^(#{{1,6}})\\s+(.+)$', 2) AS mt, {_H1.format(1)} AS hh, {_H1.format(2)} AS ht FROM pages),
        c AS (SELECT *, list_concat(list_transform(mh, lambda x: length(x)::INT), list_transform(hh, lambda x: x::INT)) AS lv, list_concat(mt, list_transform(ht, lambda x: regexp_replace(x, '<[^>]+>', '', 'g'))) AS tx, list_concat({_MDLINK}, {_LINK}) AS ls FROM b)
        SELECT page_id, len(lv)::INT AS n_headings, md5({S.trim('tx[1]')}) AS h1_md5, lv[1] AS level, len(ls)::INT AS n_links, ls[1] AS first_url, len({S.words(S.fold(_PLAIN))})::INT AS n_words,
        coalesce(list_bool_or(list_transform(lv[2:], lambda x, i: x - lv[i] > 1)), false)::INT AS skipped FROM c""",
    "page_text": f"""SELECT document_id, CASE WHEN err IS NULL THEN 'ready' ELSE 'error' END AS status, err AS error, md5(CASE WHEN err IS NULL THEN body ELSE '' END) AS text_md5 FROM (
        SELECT page_id AS document_id, body, CASE WHEN page_id % 5 = 0 THEN 'Legacy .doc files are not supported. Save as .docx or PDF and re-upload.' WHEN page_id % 7 = 0 THEN 'Unsupported file type: .xyz'
        WHEN body = '' THEN 'No readable text found in this file (scanned PDFs need OCR first).' END AS err FROM (SELECT page_id, {_clean("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS body FROM pages))""",
    "document_chunks": f"WITH {CHUNKS} SELECT document_id, chunk_index, length(content)::INT AS n_chars, md5(content) AS content_md5 FROM chunks",
    "corpus_excerpts": """WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INT AS rank, least(2500, length(text)) AS want FROM documents WHERE doc_id % 9 <> 0 AND text <> '' QUALIFY rank <= 20),
        b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
        t AS (SELECT *, greatest(0, least(want, 9000 - before))::INT AS taken FROM b)
        SELECT source AS project_id, doc_id AS document_id, rank, taken, md5(left(text, taken)) AS excerpt_md5 FROM t WHERE taken > 0""",
    "same_business_pairs": f"""WITH a AS (SELECT p_name AS name, count(*) AS n, {S.norm('p_name')} AS an FROM part GROUP BY p_name),
        b AS (SELECT listed, count(*) AS m, {S.norm('listed')} AS bn FROM (SELECT 'The ' || p_name || ' ' || lower(p_type) || ' hotel' AS listed FROM part) GROUP BY listed)
        SELECT name, listed, n, m FROM a JOIN b ON {S.same('an', 'bn')}""",
    "first_listed_part": f"""WITH n AS (SELECT DISTINCT p_brand, p_name || ' ' || lower(p_type) AS name, {S.norm("p_name || ' ' || lower(p_type)")} AS an FROM part),
        t AS (SELECT p_brand, p_partkey AS ord, p_retailprice, {S.norm("p_name || CASE WHEN p_size > 30 THEN ' ' || lower(p_type) || ' spa' ELSE '' END")} AS bn FROM part WHERE p_size >= 10)
        SELECT n.p_brand, name, min(ord) AS ord, arg_min(t.p_retailprice, ord) AS p_retailprice FROM n LEFT JOIN t ON n.p_brand = t.p_brand AND {S.same('an', 'bn')} GROUP BY n.p_brand, name""",
    "similar_documents": f"""WITH RECURSIVE s AS (SELECT doc_id, {_WORDSET.format(S.content_words('text'))} AS w FROM documents),
        g AS MATERIALIZED (SELECT w, min(doc_id) AS id, count(*) AS c FROM s WHERE len(w) > 0 GROUP BY w),
        e AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, {_jaccard('a.w', 'b.w')} AS sim FROM g a JOIN g b ON a.id < b.id AND len(a.w) >= len(b.w) * 0.5 AND len(b.w) >= len(a.w) * 0.5) WHERE sim >= 0.5),
        n AS MATERIALIZED (SELECT g.id, row_number() OVER (ORDER BY g.id) AS r, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before FROM g LEFT JOIN e ON e.b = g.id GROUP BY g.id),
        walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS leaders UNION ALL
          SELECT n.r, CASE WHEN list_has_any(walk.leaders, n.before) THEN walk.leaders ELSE list_append(walk.leaders, n.id) END FROM walk JOIN n ON n.r = walk.r + 1),
        l AS (SELECT unnest(leaders) AS id FROM walk QUALIFY r = max(r) OVER ()),
        f AS (SELECT g.id, coalesce(min(e.a), g.id) AS leader, coalesce(arg_min(e.sim, e.a), 1.0) AS sim, any_value(g.c) AS c, any_value(g.w) AS w FROM g LEFT JOIN (SELECT e.* FROM e JOIN l ON e.a = l.id WHERE e.b NOT IN (SELECT id FROM l)) e ON e.b = g.id GROUP BY g.id)
        SELECT s.doc_id, f.leader AS leader_id, round(f.sim, 6) AS similarity, z.size AS group_size FROM f JOIN s ON s.w = f.w JOIN (SELECT leader, sum(c)::BIGINT AS size FROM f GROUP BY leader) z ON z.leader = f.leader""",
    "benchmark_overlap": f"""WITH i AS (SELECT item_id AS id, {_WORDSET.format(S.content_words('text'))} AS w FROM benchmark), p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
        d AS (SELECT doc_id * 10000 + k AS id, {_WORDSET.format(S.content_words('x'))} AS w FROM (SELECT doc_id, k, ps[k + 1] AS x FROM (SELECT *, unnest(range(len(ps))) AS k FROM p))),
        a AS (SELECT w, min(id) AS id, count(*) AS c FROM i WHERE len(w) > 0 GROUP BY w), b AS (SELECT w, min(id) AS id, count(*) AS c FROM d WHERE len(w) > 0 GROUP BY w)
        SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, a.c AS copies_a, b.c AS copies_b, round({_jaccard('a.w', 'b.w')}, 6) AS similarity FROM a JOIN b ON len(a.w) >= len(b.w) * 0.4 AND len(b.w) >= len(a.w) * 0.4) WHERE similarity >= 0.4""",
    "topic_mentions": f"""SELECT doc_id, array_to_string(ts, '|') AS topics, coalesce(list_filter(ts, lambda t: t <> 'joined')[1], ts[1]) AS primary_topic, {S.join("list_filter(ts, lambda t: t IN ('company', 'past'))")} AS audience
        FROM (SELECT doc_id, {_TL} AS ts FROM (SELECT doc_id, {S.fold('text')} AS f FROM documents))""",
    "topic_table_matches": f"""SELECT topic_id, {S.label('topic_id', D.PROSE_WORDS)} AS label, lang, count(*) AS texts FROM (SELECT lang, unnest({_TL}) AS topic_id FROM (SELECT lang, {S.fold('text')} AS f FROM documents)) GROUP BY ALL""",
    "phrase_table_matches": f"""WITH items AS (SELECT item_id, {S.words(S.fold('text'))} AS w FROM benchmark),
        ph AS (SELECT DISTINCT item_id AS topic_id, phrase FROM (SELECT item_id, unnest([array_to_string(w[1:k], ' ') FOR k IN [1, 2, 3, 5, 8]]) AS phrase FROM items) WHERE phrase <> ''),
        d AS (SELECT doc_id, ' ' || array_to_string({S.words(S.fold('text'))}, ' ') || ' ' AS t FROM documents)
        SELECT topic_id, phrase, count(DISTINCT doc_id) AS texts FROM ph JOIN d ON contains(t, ' ' || phrase || ' ') GROUP BY ALL""",
    "phrase_hits": f"""SELECT lang, {', '.join(f"count(*) FILTER ({S.phrase('f', p)}) AS p_{p.replace(' ', '_')}" for p in ('of the', 'the thing', 'les', 'und der', 'apache license'))}
        FROM (SELECT lang, {S.fold('text')} AS f FROM documents) GROUP BY lang""",
    "rule_phrases": f"""SELECT p_partkey, CASE WHEN regexp_matches(r, {S.q('(?i)' + V.NEGATIVE_RULE)}) THEN {S.join(f'''list_filter(list_concat(regexp_extract_all(r, {S.q(V.QUOTED_PHRASE)}, 1), [regexp_extract(r, {S.q('(?i)' + V.NEVER_CALL)}, 1)]), lambda x: x <> '')''')} ELSE '' END AS banned,
        {_CLAIM} AS claim FROM (SELECT p_partkey, {_RULE} AS r FROM part)""",
}
