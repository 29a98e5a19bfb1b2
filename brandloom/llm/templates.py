"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens: tags with the path of open elements (so that the same tag in another
role is another token) and whole text blocks with their path, inside the main container too.
Tokens of a host's pages are grouped by their occurrence vectors, the counts in each distinct page;
a vector is summed up as an order-free digest, so pages of a host never meet in one task. Tokens
that are in SUPPORT of the pages make the classes. A class is valid if its tokens come in one order
on all its pages and its runs never cross the run of another class; valid classes are nested by
position: a text stands in the slot (the gap after a token) of the innermost run that is open there.
Tokens of other classes are template tokens without slots.

Template text is dropped, but in the main container only where its role (its path of elements) holds
more of it than of other text: a paragraph among paragraphs stays. Each slot is judged over all pages of the host: one
with mostly link text is no main text, and where some slots are mostly inside <article> or <main>
only those are. A page with no text in such slots, or of a host without template, goes by its
elements alone. The lists of elements and names are an aid: they leave out what never holds main
text and give the votes of the slots.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import bounded, stored

LEAST_PAGES = 4  # a host's template needs as many distinct pages
SUPPORT = 0.5  # and its tokens are in this share of them
MAX_HOSTS = 200_000

# Elements and names that never hold main text, and elements that do.
SKIP = set("head script style noscript template nav header footer aside button select option textarea label fieldset iframe object svg canvas dialog menu".split())
RAW = set("script style textarea title noscript iframe".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
MAIN = set("article main".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP_NAMES = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer "
    "comment comments commentlist comment-list comments-area comment-respond respond replies disqus share social related newsletter subscribe login search widget pagination skip".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>", re.S)
_MAIN_TAG = re.compile(r"<(?:article|main)\b|\brole\s*=\s*[\"']?main\b", re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def skip_name(names: dict[str, str]) -> bool:
    """Whether a class, an id or a role of an element is listed, as a whole word."""
    return any(v in ("navigation", "search", "banner") if k == "role" else not SKIP_NAMES.isdisjoint(v.lower().split()) for k, v in names.items())


def tokens(page: str, lax: bool = False) -> Iterator[tuple[str, str, bool, bool, bool, str]]:
    """(kind, value, skipped, main, link, path) in page order; kind is tag or inline (value: role) or text (raw text).

    Names skip neither html and body nor a main container; if lax, nothing outside one."""
    stack: list[tuple[str, bool, bool, bool, str]] = []
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        _, skipped, main, link, path = stack[-1] if stack else ("", False, False, False, "")
        if end > at:
            yield "text", page[at:end], skipped, main, link, path
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            role = (stack[-1][4] if stack else "") + "/-" + name
        else:
            names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(m[3])} if m[3] else {}
            if name == "p" and any(x[0] == "p" for x in stack):  # ends an open one, also below inline elements
                k = len(stack)
                while stack[k - 1][0] in INLINE:
                    k -= 1
                if stack[k - 1][0] == "p":
                    del stack[k - 1 :]
            inside = main or name in MAIN or names.get("role") == "main"
            named = main or not (lax or inside or name in ("html", "body"))
            skip = skipped or name in SKIP and not (name == "header" and main) or named and bool(names) and skip_name(names)
            above = stack[-1][4] if stack else ""
            role = above + "/" + name + "".join(f"[{_DIGITS.sub('#', v)}]" for v in sorted(names.values()))
            if name in RAW:
                close = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            elif name not in VOID and not m[3].endswith("/"):
                stack.append((name, skip, inside, link or name == "a", above if name in INLINE else above + "/" + name))
        yield "tag" if name not in INLINE else "inline", role, skipped, main, link, path


def parts(page: str) -> list[tuple[int, str, bool, int, int]]:
    """The parts of a page; where a named element holds all the text or the main container, names outside it skip nothing."""
    own = list(_parts(page, False))
    text = [main for _, t, main, _, _ in own if t]
    if not text or not any(text) and _MAIN_TAG.search(page):
        more = list(_parts(page, True))
        if not text or any(main for _, t, main, _, _ in more if t):
            return more
    return own


def _parts(page: str, lax: bool) -> Iterator[tuple[int, str, bool, int, int]]:
    """(token, text, main, link, role) in page order: tags, whose text is empty, and the visible text blocks outside
    skipped elements, decoded, with whether the main container has them, how many characters are links and their role."""
    found: list[str] = []
    inside, links, where = False, 0, ""
    for kind, value, skipped, main, link, path in chain(tokens(page, lax), [("tag", "", False, False, False, "")]):
        if kind == "text":
            if not skipped:
                found.append(value)
                inside, where = main, path
                links += len(value) if link else 0
        elif kind == "tag":
            if found:
                text = " ".join(html.unescape("".join(found)).split())
                if text:
                    yield _key("text", f"{where} {text}"), text, inside, min(links, len(text)), _key("role", where)
                found, links = [], 0
            if value:
                yield _key("tag", value), "", False, 0, 0


def _key(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {value}".encode("utf-8", "surrogatepass")) - (1 << 63)


def slots(keys: Iterable[int], classes: dict[int, int], sizes: dict[int, int], crossed: set[int] | None = None) -> Iterator[int]:
    """For each token of a page the slot it stands in: the last token of the innermost open run, or 0.
    classes: the class of each token, 0 for tokens without. Classes whose run crosses one that began before go to crossed."""
    stack: list[list[int]] = []  # class, tokens seen, last token
    for k in keys:
        yield stack[-1][2] if stack else 0
        c = classes.get(k, 0)
        if not c or sizes[c] < 2:
            continue
        if any(x[0] == c for x in stack):
            while stack[-1][0] != c:
                x = stack.pop()
                if crossed is not None:
                    crossed.add(x[0])
            stack[-1][1:] = stack[-1][1] + 1, k
            if stack[-1][1] == sizes[c]:
                stack.pop()
        else:
            stack.append([c, 1, k])
    if crossed is not None:
        crossed.update(x[0] for x in stack)


def _sequences(pages: DataFrame) -> DataFrame:
    """_host, _page and the tokens of each page in order with the characters, link characters, main characters and role of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [parts(x.as_py()) for x in b.column(2)]
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([[y[0] for y in x] for x in own], longs), pa.array([[len(y[1]) for y in x] for x in own], ints),
                    pa.array([[y[3] for y in x] for x in own], ints), pa.array([[len(y[1]) if y[2] else 0 for y in x] for x in own], ints), pa.array([[y[4] for y in x] for x in own], longs),
                ],
                names=["_host", "_page", "keys", "chars", "links", "mains", "roles"],
            )

    return stored(pages.select("_host", "_page", "_html").mapInArrow(run, "_host string, _page long, keys array<long>, chars array<int>, links array<int>, mains array<int>, roles array<long>"))


def _occurrences(sequences: DataFrame) -> DataFrame:
    """_host, _page, token, n: how often each token occurs in a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, page, token, n = [], [], [], []
            for h, p, x in zip(*(c.to_pylist() for c in b.columns)):
                count = Counter(x)
                host += [h] * len(count)
                page += [p] * len(count)
                token += count.keys()
                n += count.values()
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(token, pa.int64()), pa.array(n, pa.int32())], names=["_host", "_page", "token", "n"])

    counts = sequences.select("_host", "_page", "keys").mapInArrow(run, "_host string, _page long, token long, n int")
    return counts.groupBy("_host", "_page", "token").agg(F.max("n").alias("n"))  # pages that repeat count once


def _classes(sequences: DataFrame) -> DataFrame:
    """_h, tokens and classes: the tokens of each host with enough support, and the vector of each."""
    vectors = _occurrences(sequences).groupBy("_host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("_page", "n")).alias("vector"))
    hosts = sequences.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("all")).filter(F.col("all") >= LEAST_PAGES)
    hosts = bounded(stored(hosts.withColumnRenamed("_host", "_h")), MAX_HOSTS)
    enough = vectors.join(hosts, F.col("_host") == F.col("_h")).filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("all") * SUPPORT))
    return stored(enough.groupBy("_h").agg(F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("classes")))


def _of_host(rows: DataFrame, template: DataFrame) -> DataFrame:
    return rows.join(bounded(template, MAX_HOSTS), F.col("_host") == F.col("_h"))


def _valid(sequences: DataFrame, classes: DataFrame) -> DataFrame:
    """_host, class: classes of one order on all their pages whose runs cross no other run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, cls, order = [], [], []
            for h, keys, tokens_, groups in zip(*(c.to_pylist() for c in b.columns)):
                known = dict(zip(tokens_, groups))
                own: dict[int, list[int]] = {}
                for k in keys:
                    if k in known:
                        own.setdefault(known[k], []).append(k)
                sizes = {c: len(set(x)) for c, x in own.items()}
                ordered = {c for c, x in own.items() if x == x[: sizes[c]] * (len(x) // sizes[c])}
                crossed: set[int] = set()
                deque(slots(keys, {k: c for k, c in known.items() if c in ordered}, sizes, crossed), 0)
                host += [h] * len(own)
                cls += own
                order += [_key("order", repr(x[: sizes[c]])) if c in ordered and c not in crossed else None for c, x in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(cls, pa.int64()), pa.array(order, pa.int64())], names=["_host", "class", "order"])

    found = _of_host(sequences.select("_host", "keys"), classes).select("_host", "keys", "tokens", "classes").mapInArrow(run, "_host string, class long, order long")
    return found.groupBy("_host", "class").agg(F.count("*").alias("n"), F.count("order").alias("ok"), F.min("order").alias("low"), F.max("order").alias("high")).filter("n = ok AND low = high").select("_host", "class")


def _slot_sums(sequences: DataFrame, valid: DataFrame) -> DataFrame:
    """For each slot of a host the characters that are no template text, of links and of the main container (chars, links,
    mains); for each role in the main container how many text blocks are template text and how many are not (fixed, free)."""
    names = ["chars", "links", "mains", "fixed", "free"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, bool, int], list[int]] = {}
            for h, keys, chars, links, mains, roles, tokens_, groups in zip(*(c.to_pylist() for c in b.columns)):
                known = dict(zip(tokens_, groups))
                for slot, k, *n, role in zip(slots(keys, known, Counter(groups)), keys, chars, links, mains, roles):
                    if n[0] and k not in known:
                        own = sums.setdefault((h, False, slot), [0] * 5)
                        own[:3] = [x + y for x, y in zip(own, n)]
                    if n[2]:
                        sums.setdefault((h, True, role), [0] * 5)[3 if k in known else 4] += 1
            columns = [pa.array([x[0] for x in sums], pa.string()), pa.array([x[1] for x in sums], pa.bool_()), pa.array([x[2] for x in sums], pa.int64()), *(pa.array([x[j] for x in sums.values()], pa.int64()) for j in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=["_host", "is_role", "key", *names])

    own = _of_host(sequences.select("_host", "keys", "chars", "links", "mains", "roles"), valid)
    out = own.select("_host", "keys", "chars", "links", "mains", "roles", "tokens", "classes").mapInArrow(run, "_host string, is_role boolean, key long, " + ", ".join(f"{c} long" for c in names))
    return out.groupBy("_host", "is_role", "key").agg(*(F.sum(c).alias(c) for c in names))


def templates(pages: DataFrame) -> DataFrame:
    """_h, tokens, classes (0 without a valid one), slots and roles: the template of each host, its slots of main text
    and the roles in the main container where text that repeats is no template text."""
    sequences = _sequences(pages)
    classes = _classes(sequences)
    right = _valid(sequences, classes).groupBy("_host").agg(F.collect_list("class").alias("right"))
    right = classes.join(right, F.col("_h") == F.col("_host"), "left").withColumn("right", F.coalesce("right", F.array().cast("array<long>")))
    valid = stored(right.select("_h", "tokens", F.expr("transform(classes, c -> IF(array_contains(right, c), c, 0L))").alias("classes")))
    sums = _slot_sums(sequences, valid)
    flat = ~F.col("is_role") & (F.col("links") * 2 <= F.col("chars"))
    main, free = flat & (F.col("mains") * 2 > F.col("chars")), F.col("is_role") & (F.col("fixed") > 0) & (F.col("free") >= F.col("fixed"))
    best = sums.groupBy("_host").agg(F.bool_or(main).alias("any"), *(F.collect_list(F.when(x, F.col("key"))).alias(c) for x, c in ((main, "inner"), (flat, "flat"), (free, "roles"))))
    best = best.select(F.col("_host").alias("_b"), F.when(F.col("any"), F.col("inner")).otherwise(F.col("flat")).alias("slots"), "roles")
    return stored(valid.join(best, F.col("_h") == F.col("_b"), "left").select("_h", "tokens", "classes", "slots", "roles"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    A null html is an empty page, whose text is empty. Pages without a host in their url are a
    host of their own. Hosts with fewer than LEAST_PAGES distinct pages have no template; there the
    elements alone decide. Repeated rows give a row each. Nothing is cut; other columns are not
    read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), _HOST, 1).alias("_host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    rows = rows.withColumn("_page", F.xxhash64("_html"))
    joined = rows.join(bounded(templates(rows), MAX_HOSTS), F.col("_host") == F.col("_h"), "left").select("page_id", "url", "_html", "_h", "tokens", "classes", "slots", "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last = [], None
            for j, x in enumerate(b.column(2)):
                h = b.column(3)[j].as_py()
                if last is None or h != last[0]:
                    tokens_, groups, *more = (b.column(c)[j].as_py() or () for c in (4, 5, 6, 7))
                    last = h, dict(zip(tokens_, groups)), Counter(groups), *map(set, more)
                _, known, sizes, good, free = last
                own = parts(x.as_py())
                text = [(t, main, k in known or slot in good) for (k, t, main, _, role), slot in zip(own, slots((y[0] for y in own), known, sizes)) if t and (k not in known or main and role in free)]
                kept = [t for t, _, right in text if right] if known else []
                if not kept:
                    inner = [t for t, main, _ in text if main]
                    kept = inner or [t for t, _, _ in text]
                out.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
