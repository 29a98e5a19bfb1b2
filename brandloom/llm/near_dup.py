"""N-gram Jaccard join by a token-group matrix, and the groups of documents that it links.

1. Equal shingle sets become one (their least doc_id stands for them).
2. Similar sets form groups: sets that agree in a pair of min-hashes are compared with one
   leader, and linked sets are a group. This only makes the matrix small; it decides nothing else.
3. The matrix lists, for each token, the groups that have it among the leading tokens of a
   member: those of which two similar sets must share so many, in an order that all sets have in
   common: by the number of documents that have a token, or one of the tokens that begin with the
   same bits, so the most frequent come last. All documents are counted.
4. A set's row of the matrix counts the tokens that it shares with each group. Only groups that
   reach the bound are asked; such a group is opened if the set's overlap with the union of all
   its tokens reaches the bound too, and then its members are compared with whole sets. Groups
   larger than GROUP_ROWS are dealt into parts.
5. Links within and between groups give the connected components.

Tokens are 64-bit hashes of shingles. Any order of the tokens gives the same links, so tokens that
are counted together do not touch the result. The driver gets the counts, whose number is fixed, and
broadcasts of bounded size; lists of ids that grow with the documents are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brandloom.llm import common
from brandloom.llm.common import bounded, sifted, small_batches, stored, text_of, without
from brandloom.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100  # linked at this Jaccard similarity or more
BANDS = 4
ROUNDS = 3  # of comparing sets with leaders
SLACK = 20
GROUP_ROWS = 32
BUCKET_BITS, SLICE_BITS = 22, 16  # of a token: counted by its first bits, in slices of buckets
LEADER_ROWS = 20_000  # sets that meet one leader in one task at most, about
REMEMBERED = 100_000
# Of a token at place `at` of n: two linked sets of n and m tokens share n // SLACK + 1 tokens that have
# edge < -NUMERATOR * m here, and the same there, as they share NUMERATOR * (n + m) / (DENOMINATOR + NUMERATOR).
EDGE = f"{DENOMINATOR + NUMERATOR} * (at - n DIV {SLACK} - 1) - {DENOMINATOR} * n"

_seen: dict[bytes, bytes] = {}
_K = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(word: bytes) -> bytes:
    h = xxhash.xxh3_64_digest(word)
    if len(word) <= 40:
        if len(_seen) >= REMEMBERED:
            _seen.clear()
        _seen[word] = h
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def tokens_of(text: bytes) -> np.ndarray:
    """The ascending 64-bit hashes of the distinct shingles; of the whole if it has fewer words.

    The text is UTF-8: lower() and split() of bytes know A-Z and the six ASCII spaces only.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join([_seen.get(w) or _hash(w) for w in words]), np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else 0, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k : k + n] * _K[k]
    return np.unique(_mix(out))


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def leading(tokens: np.ndarray, hot: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
    """So many tokens, frequent ones last by their counts, that a linked set of no fewer tokens shares n // SLACK + 1 of them.

    counts: of the ascending tokens in hot, or of all buckets where hot is None.
    Two sets of n and m tokens are linked only if they share 0.75 of either. Then the first k
    tokens that they share are among the first n - ceil(0.75 n) + k of the one, and likewise of
    the other.
    """
    n = len(tokens)
    need = -(-NUMERATOR * n // DENOMINATOR)
    if hot is None:
        tokens = tokens[np.argsort(counts[_buckets(tokens)], kind="stable")]
    elif len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        tokens = tokens[np.argsort(np.where(hot[at] == tokens, counts[at], 0), kind="stable")]
    return tokens[: n - need + 1 + n // SLACK]


def _bands(tokens: np.ndarray) -> np.ndarray:
    low = np.array([(tokens * s).min() for s in _SEEDS], np.uint64)
    return _mix(low[::2] * np.uint64(31) + low[1::2] + np.arange(BANDS, dtype=np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def token_counts(docs: DataFrame) -> np.ndarray:
    """By bucket, how often the sets of all documents have a token of it.

    A task sends the buckets that it has seen, a row for each slice; the driver gets 1 << BUCKET_BITS numbers.
    """
    width = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.uint32)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, _buckets(tokens_of(t.as_py())), np.uint32(1))
        for k, own in enumerate(n.reshape(-1, width)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<u4").tobytes()], pa.binary())], names=["slice", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                sums.setdefault(k, np.zeros(width, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(n, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["slice", "n"])

    slices = docs.select(text_of().cast("binary").alias("text")).mapInArrow(count, "slice int, at binary, n binary").repartition("slice")
    found = slices.mapInArrow(add, "slice int, n binary").toArrow()
    counts = np.zeros((1 << BUCKET_BITS - SLICE_BITS, width), np.uint32)
    for k, n in zip(found["slice"].to_pylist(), found["n"].to_pylist()):
        counts[k] = np.frombuffer(n, "<u4")
    return counts.ravel()


def _profile(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """id, n, two hashes of the set, leading tokens and band keys of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [tokens_of(t.as_py()) for t in b.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([leading(s, None, shared.value) for s in sets]), _lists([_bands(s) if len(s) else s for s in sets])],
                names=["id", "n", "key", "leading", "bands"],
            )

    rows = docs.select(F.col("doc_id").alias("id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, key binary, leading array<long>, bands array<long>")


def overlap_reached(common: int, n: int, m: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (n + m - common)


def _compare(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """Links (a, b) of queries with the first similar member of the groups they ask.

    roles: id, g, part, query (0: member of the group part, 1: asks it). A set's tokens are made
    where its text is read and move once for each role; a part's members come before its queries,
    which are then read as a stream, so only the members are held. Texts without a role don't move.
    """
    kind = roles.schema["id"].dataType.simpleString()
    asked = stored(roles.groupBy("id").agg(F.collect_list(F.struct("g", "part", "query")).alias("roles")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, own in zip(batch.column(0), batch.column(1), batch.column(2)):
                own, t = own.as_py(), tokens_of(text.as_py()).tobytes()
                for k in range(0, len(own), 256):
                    r = own[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["g"] for x in r], batch.schema.field(0).type), pa.array([x["part"] for x in r], pa.int64()), pa.array([x["query"] for x in r], pa.int32()), pa.array([i.as_py()] * len(r), batch.schema.field(0).type), pa.array([t] * len(r), pa.binary())],
                        names=["g", "part", "query", "id", "tokens"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, union = None, [], None
        for batch in batches:
            a, b = [], []
            for g, part, query, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(x, np.uint64)
                if (g, part) != at:
                    at, group, union = (g, part), [], None
                if not query:
                    group.append((i, s))
                    continue
                if union is None and group:
                    union = group[0][1] if len(group) == 1 else np.unique(np.concatenate([t for _, t in group]))
                if not group or DENOMINATOR * _common(s, union) < NUMERATOR * len(s):
                    continue  # no member can be linked: the group stays closed
                for j, t in group:
                    if i != j and overlap_reached(_common(s, t), len(s), len(t)):
                        a.append(i)
                        b.append(j)
                        break  # a group's members are linked among themselves, so one link tells all
            kind = batch.schema.field(3).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    texts = docs.select("doc_id", text_of().cast("binary").alias("text"))
    if (asked.agg(F.sum(F.size("roles"))).first()[0] or 0) <= common.FEW_IDS:
        asked = F.broadcast(asked)
    else:  # only texts that may have a role are shuffled
        texts, _ = sifted(texts, "doc_id", asked.select("id"))
    rows = texts.join(asked, F.col("doc_id") == F.col("id")).select("id", "text", "roles").mapInArrow(send, f"g {kind}, part long, query int, id {kind}, tokens binary").repartition("g", "part").sortWithinPartitions("g", "part", "query")
    return rows.mapInArrow(meet, f"a {kind}, b {kind}")


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """How many tokens two ascending sets share."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def _leaders(sets: DataFrame) -> DataFrame:
    """a, b, times: each set with the leaders (least ids) of its bands."""
    rows = sets.select("id", F.explode("bands").alias("band"))
    lead = rows.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b < last").select("band", "b")
    return rows.join(lead, "band").filter("id > b").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("times"))


def _groups(links: DataFrame) -> DataFrame:
    """id, g, part of linked ids: the component, dealt into parts of about GROUP_ROWS."""
    group = stored(components(links).select("id", F.col("component").alias("g")))
    parts = group.groupBy("g").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    return stored(group.join(parts, "g").select("id", "g", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")))


def _near(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing sets with leaders, and the groups that they make.

    In each round a set meets the one leader, of another group and not met before, that it has in
    most bands.
    """
    open_ = stored(_leaders(sets))
    links = None
    for k in range(ROUNDS):
        lead = open_.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
        parts = lead.groupBy("b").agg(F.ceil(F.count("*") / LEADER_ROWS).alias("parts"))
        lead = stored(lead.join(parts, "b").select("a", "b", "parts"))
        asks = lead.select(F.col("a").alias("id"), F.col("b").alias("g"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(1).alias("query"))
        leads = lead.select("b", "parts").distinct().select(F.col("b").alias("id"), F.col("b").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("query"))
        found = _compare(docs, asks.unionByName(leads))
        links = stored(found if links is None else links.unionByName(found))
        group = _groups(links)
        if k < ROUNDS - 1:
            g = [group.select(F.col("id").alias(c), F.col("g").alias(f"g{c}")) for c in "ab"]
            apart = ~F.coalesce("ga", "a").eqNullSafe(F.coalesce("gb", "b"))
            open_ = stored(open_.join(lead, ["a", "b"], "left_anti").join(g[0], "a", "left").join(g[1], "b", "left").filter(apart).select("a", "b", "times"))
    return links, group


def _ask(docs: DataFrame, met: DataFrame, group: DataFrame) -> DataFrame:
    """Links of the sets in met (id, g, part) with the members of those group parts."""
    grouped = group.join(met.select("g", "part").distinct(), ["g", "part"], "left_semi").select("id", "g", "part")
    single = met.select("g").distinct().join(group.select("g").distinct(), "g", "left_anti").select(F.col("g").alias("id"), "g", F.lit(0).cast("long").alias("part"))
    members = grouped.unionByName(single).withColumn("query", F.lit(0))
    return stored(_compare(docs, met.select("id", "g", "part").withColumn("query", F.lit(1)).unionByName(members)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    component_id is the least doc_id that is reached over links. A text without words (or null)
    has no shingles and no links. A row with a null doc_id gets its n_shingles and a null
    component_id. Rows that repeat a doc_id are one node: links of any of them count. Other
    columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    rows = stored(_profile(docs.select("doc_id", "text"), token_counts(known)))
    kind = rows.schema["id"].dataType.simpleString()
    least = stored(rows.filter("n > 0 AND id IS NOT NULL").groupBy("key", "n").agg(F.min("id").alias("least")))
    wordy = rows.filter("n > 0 AND id IS NOT NULL")
    copies = stored(wordy.select(F.col("id").alias("copy")).join(least.select("least"), F.col("copy") == F.col("least"), "left_anti").distinct())
    sets = without(wordy, "id", copies)

    near, group = _near(known, sets)

    # Tokens that one set has alone can't link: they go before the groups are looked up.
    token = W.partitionBy("token")
    posts = sets.select(F.posexplode("leading").alias("at", "token"), "id", "n").withColumn("edge", F.expr(EDGE))
    posts = posts.withColumns({"lo": F.min("id").over(token), "hi": F.max("id").over(token), "fewest": F.min("n").over(token)}).filter(f"lo < hi AND edge < -{NUMERATOR} * fewest")
    posts = stored(posts.join(bounded(group, common.FEW_IDS), "id", "left").select("token", "id", "n", "edge", F.coalesce("g", "id").alias("g"), F.coalesce("part", F.lit(0)).alias("part")))
    shared = posts.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("token")
    posts = stored(posts.join(shared, "token", "left_semi"))
    matrix = posts.groupBy("token", "g", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("edge").alias("there"))
    q = posts.select("token", "id", "n", "edge", F.col("g").alias("own"))
    fits = (F.col("own") < F.col("g")) & (DENOMINATOR * F.col("n") >= NUMERATOR * F.col("least")) & (DENOMINATOR * F.col("most") >= NUMERATOR * F.col("n"))
    fits &= (F.col("edge") < -NUMERATOR * F.col("least")) & (F.col("there") < -NUMERATOR * F.col("n"))
    shared = q.join(matrix, "token").filter(fits).groupBy("id", "g", "part").agg(F.count("*").alias("common"), F.min(F.least("n", "least")).alias("fewest"))
    met = stored(shared.filter(F.col("common") > F.floor(F.col("fewest") / SLACK)).select("id", "g", "part", "common"))

    # A group's best part is asked first. The others are asked only where the two are still apart.
    first = stored(met.groupBy("id", "g").agg(F.max_by("part", F.struct("common", "part")).alias("part")))
    links = stored(near.unionByName(_ask(known, first, group)))
    now = _groups(links).select("id", F.col("g").alias("now"))
    rest = met.join(first, ["id", "g", "part"], "left_anti").join(now, "id", "left").join(now.select(F.col("id").alias("g"), F.col("now").alias("then")), "g", "left")
    rest = stored(rest.filter(~F.coalesce("now", "id").eqNullSafe(F.coalesce("then", "g"))).select("id", "g", "part"))
    links = links.unionByName(_ask(known, rest, group))

    part_of = components(links)
    same = stored(least.join(part_of, F.col("id") == F.col("least"), "left").select("key", F.col("n").alias("m"), F.coalesce("component", "least").alias("component_id")))
    out = rows.join(same, (rows["key"] == same["key"]) & (F.col("n") == F.col("m")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
