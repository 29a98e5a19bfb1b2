"""Passage retrieval: exact vector top-k and full-text top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import trim_ws
from brandloom.functions.text import drop_accents
from brandloom.operators.topics import top_rows
from brandloom.session import cut_lineage, stored

#: Bytes of query vectors sent to the tasks at once; more queries take more passes over the chunks.
SLICE_BYTES = 32 << 20
#: Vectors around which a task's chunks are grouped, so that whole groups can be ruled out.
PIVOTS = 64
SLACK = 1e-9  # of a similarity: rows this near to the last place are computed again, row by row


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, in double."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(rows: list) -> np.ndarray:
    m = np.asarray(rows, dtype=np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0, np.nan, norms)


class _Nearest:
    """The k nearest chunks of each query among the batches of one task, so far.

    Chunks stand in groups around their nearest pivot. No chunk of a group is nearer to a query
    than the pivot's angle to it less the group's radius allows, so a group is compared only with
    the queries for which that reaches their last place."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.k, self.pivots = ids, queries, k, pivots
        self.angle = np.arccos(np.clip(queries @ pivots.T, -1, 1))
        self.found: list[list] = [[] for _ in ids]  # (-similarity, chunk_id)
        self.last = np.full(len(ids), -np.inf)

    def add(self, chunk_ids: np.ndarray, chunks: np.ndarray) -> None:
        known = ~np.isnan(chunks).any(axis=1)
        chunk_ids, chunks = chunk_ids[known], chunks[known]
        if not len(chunk_ids):
            return
        near = chunks @ self.pivots.T
        group = near.argmax(axis=1)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            radius = np.arccos(np.clip(near[rows, g].min(), -1, 1))
            bound = np.cos(np.maximum(self.angle[:, g] - radius, 0))
            asked = np.flatnonzero(~(bound + SLACK < self.last))  # a query of zeros has no similarity to any
            if len(asked):
                sims = self.q[asked] @ chunks[rows].T
                for i, s in zip(asked, sims):
                    self._offer(i, rows, s, chunk_ids, chunks)

    def _offer(self, i: int, rows: np.ndarray, sims: np.ndarray, chunk_ids: np.ndarray, chunks: np.ndarray) -> None:
        pick = np.flatnonzero(sims + SLACK >= self.last[i])
        if len(pick) > self.k:
            bar = np.partition(sims[pick], len(pick) - self.k)[len(pick) - self.k]
            pick = pick[sims[pick] + SLACK >= bar]
        if len(pick):
            exact = (chunks[rows[pick]] * self.q[i]).sum(axis=1)  # the same for equal vectors, wherever they stand
            self.found[i] = sorted([*self.found[i], *zip((-exact).tolist(), chunk_ids[rows[pick]].tolist())])[: self.k]
            if len(self.found[i]) == self.k:
                self.last[i] = -self.found[i][-1][0]

    def frame(self) -> pd.DataFrame:
        rows = [(q, c, -s) for q, found in zip(self.ids, self.found) for s, c in found]
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "similarity"])


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, slice_bytes: int = SLICE_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """``queries``: project_id, query_id, embedding. ``chunks``: project_id, chunk_id,
    embedding. Returns project_id, query_id, chunk_id, similarity, rank; ties go to the smaller chunk id.

    A task keeps the k best rows of each query over all its batches, so no (query, chunk) list
    exists and k rows leave a task for each query. Query vectors travel with the tasks in slices
    of ``slice_bytes``, which are counted first; each slice is a pass over the chunks."""
    spark = chunks.sparkSession
    pid, qid, cid = (df.schema[c].dataType.simpleString() for df, c in ((queries, "project_id"), (queries, "query_id"), (chunks, "chunk_id")))
    live = chunks.filter(F.col("embedding").isNotNull()).select("project_id", "chunk_id", "embedding")
    asked = cut_lineage(queries.filter(F.col("embedding").isNotNull()).select("project_id", "query_id", "embedding"))
    size = asked.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()[0]
    n = max(1, -(-size // slice_bytes))
    around = spark.sparkContext.broadcast([r.embedding for r in live.orderBy(F.xxhash64("chunk_id")).limit(pivots).select("embedding").collect()])
    hits = None
    for part in range(n):
        by_project: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("project_id", "query_id"), F.lit(n)) == part).collect():
            by_project.setdefault(r.project_id, []).append(r)
        shared = spark.sparkContext.broadcast({p: (np.array([r.query_id for r in rs]), _unit([r.embedding for r in rs])) for p, rs in by_project.items()})

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pivots, state = None, {}
            for pdf in batches:
                for p, rows in pdf.groupby("project_id", sort=False, dropna=False):
                    p = None if pd.isna(p) else p
                    if p in shared.value:
                        if pivots is None:
                            pivots = np.nan_to_num(_unit(around.value))
                        if p not in state:
                            state[p] = _Nearest(*shared.value[p], pivots, k)
                        state[p].add(rows["chunk_id"].to_numpy(), _unit(rows["embedding"].tolist()))
            for p, nearest in state.items():
                yield nearest.frame().assign(project_id=p)[["project_id", "query_id", "chunk_id", "similarity"]]

        found = live.mapInPandas(scan, f"project_id {pid}, query_id {qid}, chunk_id {cid}, similarity double")
        hits = found if hits is None else hits.unionByName(found)
    return top_rows(hits, ["project_id", "query_id"], [F.desc("similarity"), "chunk_id"], k)


# --- full text ---------------------------------------------------------------------


def search_terms(texts: Column, limit: int = 30) -> Column:
    """Distinct words of three or more letters of some query texts, in order."""
    joined = drop_accents(F.lower(F.array_join(texts, " ")))
    ws = F.regexp_extract_all(joined, F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(ws, lambda w: ~w.isin(V.QUERY_STOPWORDS))), 1, limit)


def text_tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Fixed values of the rank formula: the positions of a word that count, its weight, and the
# limit of 1 + 1/4 + 1/9 + ...
MAX_POSITIONS = 256
RANK_WEIGHT = 0.1
RANK_LIMIT = 1.64493406685
#: Weights are whole numbers of this unit, so that a sum hangs on no order.
RANK_UNIT = 10**12


def word_weight(n: Column) -> Column:
    """Weight of a word that occurs n times, in units."""
    sums, total = [], 0.0
    for i in range(1, MAX_POSITIONS + 1):
        total += RANK_WEIGHT / (i * i)
        sums.append(round(total / RANK_LIMIT * RANK_UNIT))
    known = F.expr(f"array({','.join(f'{x}L' for x in sums)})")
    return F.get(known, F.least(n, F.lit(MAX_POSITIONS)).cast("int") - 1)


def token_index(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Inverted index rows (project_id, token, chunk_id, n), of the tokens in ``asked`` (token,
    distinct) if given. Write it bucketed or partitioned by token to reuse it across searches."""
    tokens = chunks.select("project_id", "chunk_id", F.explode(text_tokens(F.col("content"))).alias("token"))
    if asked is not None:  # the rest leaves before the words of a chunk are counted
        tokens = tokens.join(asked, "token", "left_semi")
    return tokens.groupBy("project_id", "chunk_id", "token").agg(F.count(F.lit(1)).alias("n"))


def text_topk(requests: DataFrame, chunks: DataFrame | None, k: int, index: DataFrame | None = None) -> DataFrame:
    """``requests``: request_id, terms, and project_id unless each is asked of all projects.
    ``chunks``: project_id, chunk_id, content, or a stored ``index`` of them (``token_index``).
    Any-word match, ranked by the summed weight of each word's occurrences (1 + 1/4 + 1/9 + ...)
    over the number of words asked for; k rows for each project and request.

    Only chunks that can reach the last place are scored. The rarest words of a request are
    scored first and give a bound of its k-th score. The most frequent words whose greatest
    weights together stay below it cannot bring a chunk in alone: their postings are not read
    for candidates, only looked up for the chunks that the other words found."""
    by = ["project_id"] if "project_id" in requests.columns else []
    wanted = requests.select(*by, "request_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("token"))
    index = stored(token_index(chunks, wanted.select("token").distinct())) if index is None else index
    index = index.withColumn("weight", word_weight(F.col("n"))).select("project_id", "token", "chunk_id", "weight")
    known = index.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("chunks"), F.max("weight").alias("most"))
    at = ["project_id", "request_id"]
    order = Window.partitionBy(*at).orderBy(F.desc("chunks"), "token")
    terms = cut_lineage(
        wanted.join(known, [*by, "token"])
        .withColumn("upto", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)))  # of this and the more frequent words
        .withColumn("place", F.row_number().over(order) / F.count(F.lit(1)).over(Window.partitionBy(*at)))
    )

    def scored(some: DataFrame) -> DataFrame:
        return some.select(*at, "token").join(index, ["project_id", "token"]).groupBy(*at, "chunk_id").agg(F.sum("weight").alias("score"))

    rare = scored(terms.filter(F.col("place") > 0.5))
    bar = top_rows(rare, at, [F.desc("score")], k).groupBy(*at).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
    terms = cut_lineage(terms.join(bar, at, "left").withColumn("bar", F.coalesce("bar", F.lit(0).cast("long"))).withColumn("opens", F.col("upto") >= F.col("bar")))
    rest = terms.groupBy(*at).agg(F.first("bar").alias("bar"), F.first("n_terms").alias("n_terms"), F.coalesce(F.max(F.when(~F.col("opens"), F.col("upto"))), F.lit(0)).alias("rest"))
    found = scored(terms.filter("opens")).join(rest, at).filter(F.col("score") + F.col("rest") >= F.col("bar"))
    found = stored(found)
    asked = found.select(*at, "chunk_id").join(terms.filter(~F.col("opens")).select(*at, "token"), at)
    more = asked.join(index, ["project_id", "token", "chunk_id"]).groupBy(*at, "chunk_id").agg(F.sum("weight").alias("more"))
    whole = found.join(more, [*at, "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0)))
    best = top_rows(whole, at, [F.desc("score"), "chunk_id"], k)
    return best.select(*at, "chunk_id", (F.col("score") / F.lit(float(RANK_UNIT)) / F.col("n_terms")).alias("similarity"), "rank")


def with_passages(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (project_id, chunk_id, ...) with the content of their chunk, and its document's title
    and category. ``chunks``: project_id, chunk_id, document_id, content. ``documents``:
    project_id, document_id, title, category. Ranking reads narrow ids only; the texts are
    fetched for the chunks that were found, each once, and only their keys are shuffled before."""
    hits = cut_lineage(hits)
    won = hits.select("project_id", "chunk_id").distinct()
    texts = chunks.select("project_id", "chunk_id", "document_id", "content").join(won, ["project_id", "chunk_id"], "left_semi")
    texts = texts.join(documents.select("project_id", "document_id", "title", "category"), ["project_id", "document_id"], "left")
    return hits.join(texts, ["project_id", "chunk_id"])


def retrieve(requests: DataFrame, chunks: DataFrame, per_query: int = 6, max_total: int = 14) -> DataFrame:
    """``requests``: project_id, request_id, queries array<struct<text,embedding>> (the
    first eight non-blank ones count). Vector hits first; where a request finds fewer
    than half of ``max_total``, text hits (worth 0.5 at most) are added."""
    usable = F.slice(F.filter("queries", lambda q: trim_ws(F.coalesce(q["text"], F.lit(""))) != ""), 1, 8)
    reqs = requests.select("project_id", "request_id", usable.alias("queries"))
    vectors = reqs.select("project_id", "request_id", F.posexplode("queries").alias("qi", "q")).select(
        "project_id", F.concat_ws("\u0001", F.col("request_id").cast("string"), F.col("qi").cast("string")).alias("query_id"), F.col("q.embedding").alias("embedding"), "request_id", "qi"
    )
    near = vector_topk(vectors, chunks, per_query)
    near = near.join(vectors.select("project_id", "query_id", "request_id", "qi"), ["project_id", "query_id"])
    key = ["project_id", "request_id", "chunk_id"]
    by_vector = near.select(*key, "similarity", F.struct("qi", "rank").alias("seen"))
    found = by_vector.groupBy("project_id", "request_id").agg(F.count_distinct("chunk_id").alias("found"))
    short = reqs.join(found, ["project_id", "request_id"], "left").filter(F.coalesce("found", F.lit(0)) < max_total / 2)
    terms = short.select("project_id", "request_id", search_terms(F.transform("queries", lambda q: q["text"])).alias("terms"))
    by_text = text_topk(terms, chunks, max_total).select(
        *key, F.least("similarity", F.lit(0.5)).alias("similarity"), F.struct(F.lit(8).alias("qi"), "rank").alias("seen")
    )
    merged = by_vector.unionByName(by_text).groupBy(*key).agg(F.max("similarity").alias("similarity"), F.min("seen").alias("seen"))
    return top_rows(merged, ["project_id", "request_id"], [F.desc("similarity"), "seen", "chunk_id"], max_total).drop("seen")


def draft_queries(title: Column, keyword: Column, paras: Column) -> Column:
    """Query texts for a draft: its title and keyword, then its leading paragraphs."""
    head = F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(keyword, F.lit("")))
    long_ones = F.slice(F.filter(paras, lambda p: F.length(p) > 40), 1, 7)
    return F.concat(F.array(head), F.transform(long_ones, lambda p: F.substring(p, 1, 600)))
