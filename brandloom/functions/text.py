"""Text kernel: Column -> Column functions built from Catalyst built-ins only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import is_ascii, js_pattern, let, quote_regex, trim_ws

_MARKS = "".join(chr(cp) for cp in range(0x0300, 0x0370))


def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0x0300 <= cp < 0x0370 or 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        base = [x for x in unicodedata.normalize("NFD", ch) if x not in _MARKS]
        if len(base) == 1 and base[0] != ch:
            src.append(ch)
            dst.append("d" if base[0] in "đĐ" else base[0])
    return "".join(src) + "đĐ", "".join(dst) + "dd"


_SRC, _DST = _accent_table()


def fold(c: Column) -> Column:
    """Lower case without accents. ASCII text (the common case) skips the mapping."""
    return let(c, lambda t: F.when(is_ascii(t), F.lower(t)).otherwise(F.lower(F.translate(t, _SRC + _MARKS, _DST))))


def drop_accents(c: Column) -> Column:
    """Accents removed, case and other letters kept."""
    return let(c, lambda t: F.when(is_ascii(t), t).otherwise(F.translate(t, _SRC[:-2] + _MARKS, _DST[:-2])))


def words_of(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def words(c: Column) -> Column:
    return words_of(fold(c))


def drop_stopwords(ws: Column) -> Column:
    return F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(V.STOPWORDS))


def content_words(c: Column) -> Column:
    return drop_stopwords(words(c))


def first_content_words(c: Column, n: int, head: int = 400) -> Column:
    """The first ``n`` content words. Only a text whose first characters hold no more than ``n``
    is read whole; one word more is asked for, as the last one may be cut off."""
    return let(
        content_words(F.substring(c, 1, head)),
        lambda ws: F.slice(F.when((F.size(ws) > n) | (F.length(c) <= head), ws).otherwise(content_words(c)), 1, n),
    )


def sentences(c: Column) -> Column:
    spaced = F.regexp_replace(c, "\n+", " \n ")
    parts = F.split(spaced, js_pattern(r"(?<=[.!?])\s+|") + "\n")
    return F.filter(F.transform(parts, trim_ws), lambda s: F.length(s) > 1)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n{2,}"), trim_ws), lambda p: p != "")


def lines(c: Column) -> Column:
    """Entries of a multi-line profile field (newline or ';' separated)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n|;"), lambda l: trim_ws(F.regexp_replace(l, _BULLETS, "")))
    return F.filter(parts, lambda l: F.length(l) > 1)


_BULLETS = "(?i)^[" + V.WS_CLASS[1:-1] + "\\-•*✓✔❌✗x]+"


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; 0 when either is empty."""

    def share(x: Column, y: Column) -> Column:
        union, inter = F.size(F.array_union(x, y)), F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(inter / union)

    return let(a, lambda x: let(b, lambda y: share(x, y)))


def share_within(needles: Column, haystack: Column) -> Column:
    """Share of ``needles`` (duplicates kept) found in ``haystack``; 0 for none."""

    def share(n: Column, h: Column) -> Column:
        hits = F.size(F.filter(n, lambda w: F.array_contains(h, w)))
        return F.when(F.size(n) == 0, F.lit(0.0)).otherwise(hits / F.size(n))

    return let(needles, lambda n: let(haystack, lambda h: share(n, h)))


def overlap(a: Column, b: Column) -> Column:
    """Elements of ``a`` (duplicates kept) that are in ``b``."""
    return let(b, lambda h: F.filter(a, lambda t: F.array_contains(h, t)))


def without(a: Column, b: Column) -> Column:
    return let(b, lambda h: F.filter(a, lambda t: ~F.array_contains(h, t)))


def fold_phrase(p: Column) -> Column:
    return trim_ws(fold(p))


def folded_contains(folded_text: Column, folded_phrase: Column) -> Column:
    """Whole-phrase test on folded inputs. The literal test runs first, so the
    pattern is only built where the phrase occurs at all."""

    def test(text: Column, p: Column) -> Column:
        pattern = F.concat(F.lit("(?:^|[^a-z0-9])"), quote_regex(p), F.lit("(?:[^a-z0-9]|\\z)"))
        return (p != "") & F.contains(text, p) & F.rlike(text, pattern)

    return let(folded_text, lambda t: let(folded_phrase, lambda p: test(t, p)))


def contains_phrase(text: Column, phrase: Column) -> Column:
    return folded_contains(fold(text), fold_phrase(phrase))


def title_case(c: Column) -> Column:
    """Small words stay lower case unless first; the rest of a word is unchanged."""
    tokens = F.regexp_extract_all(c, F.lit(f"{V.WS_CLASS}+|[^{V.WS_CLASS[1:-1]}]+"), F.lit(0))

    def cased(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        upper = F.when(first.rlike(r"\p{L}"), F.concat(F.upper(first), w.substr(F.lit(2), F.length(w)))).otherwise(w)
        return F.when((i > 0) & F.lower(w).isin(V.TITLE_SMALL_WORDS), F.lower(w)).otherwise(upper)

    return F.array_join(F.transform(tokens, cased), "")


_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(trim_ws(url), _HOST, 1)), r"^www\.", "")


def domain_of(url: Column) -> Column:
    """Host without ``www.``; for text that is no URL, its part before the first slash."""
    plain = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "^https?://", ""), "/"), 1), r"^www\.", "")
    return let(_host(url), lambda h: F.when(h != "", h).otherwise(plain))


def citation_domain(url: Column) -> Column:
    """As ``domain_of``, but text that is no URL is returned unchanged."""
    return let(_host(url), lambda h: F.when(h != "", h).otherwise(url))


def ellipsis(c: Column, limit: int, keep: int) -> Column:
    return let(c, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit("…"))).otherwise(t))


def decode_entities(c: Column) -> Column:
    for name, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def clean_text(c: Column) -> Column:
    c = F.replace(c, F.lit("\r"), F.lit(""))
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return trim_ws(F.regexp_replace(c, "\n{3,}", "\n\n"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, V.TAG, " ")


def chunk_text(c: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Pack paragraphs into chunks of about ``size`` characters, carrying the last
    ``overlap`` characters over; oversize paragraphs are cut into strided slices."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    sep = F.lit("\n\n")

    def closed(s: Column) -> Column:
        return F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def add(s: Column, p: Column) -> Column:
        slices = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(size - overlap)),
            lambda i: p.substr(i, F.lit(size)),
        )
        joined = F.concat(s["open"], sep, p)
        tail = s["open"].substr(F.greatest(F.length(s["open"]) - (overlap - 1), F.lit(1)), F.lit(overlap))
        return (
            F.when(F.length(p) > size, F.struct(F.concat(closed(s), slices).alias("done"), F.lit("").alias("open")))
            .when(
                (F.length(joined) > size) & (s["open"] != ""),
                F.struct(closed(s).alias("done"), F.concat(tail, sep, p).alias("open")),
            )
            .otherwise(F.struct(s["done"].alias("done"), F.when(s["open"] != "", joined).otherwise(p).alias("open")))
        )

    return F.aggregate(paragraphs(c), state, add, closed)
