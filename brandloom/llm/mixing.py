"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash. A source's budget is met by taking the documents below a hash
threshold. The threshold is found without sorting: sizes are summed by source and hash bucket,
the bucket in which the budget ends is found, and only its documents are split into finer
buckets, until the hash is used up. A source that is repeated takes all documents once and
those below the threshold of what is left over twice, so the thresholds are nested: a larger
budget never takes less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brandloom.llm.common import bounded, stored, text_of, words_of

HASH_BITS = 60
LEVEL_BITS = 12
MAX_SOURCES = 10_000  # for more, the plan is joined by a shuffle


def order_hash(doc_id: Column) -> Column:
    """The leading 60 bits of the md5 of the id as text (a null id counts as empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, limit: float) -> list[tuple[str | None, float]]:
    """Target of each source: share of all sizes, dealt by weight, none above limit times its size.

    Sources take the weights in turn by code point, null last. What a full source can't take is
    dealt again by weight among the others. Without a source that has words all targets are 0.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    room = {s: limit * n for s, n in order}
    left, out, open_ = share * sum(n for _, n in order), {}, [s for s, _ in order]
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > room[s]]
        if not full:
            return [(s, float(out.get(s, weight[s] * level))) for s, _ in order]
        for s in full:
            out[s] = room[s]
        left -= sum(room[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return [(s, float(out[s])) for s, _ in order]


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash below which its budget is spent: _src, cut.

    rows: _src, size, h; budgets: _src, budget. The documents of the boundary hash are taken
    too if that comes nearer to the budget.
    """
    at = budgets.select("_src", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    inside, done = rows, None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = inside.groupBy("_src", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        run = bucket.withColumn("upto", F.sum("n").over(W.partitionBy("_src").orderBy("b")))
        hit = run.join(at, bucket["_src"].eqNullSafe(at["_src"])).select(
            at["_src"], "budget", "b", (F.col("below") + F.col("upto")).alias("upto"), "n", (F.col("below") + F.col("upto") > F.col("budget")).alias("over")
        )
        first = hit.filter("over").groupBy("_src").agg(F.min_by(F.struct("budget", "b", "upto", "n"), "b").alias("x"))
        at = stored(
            first.select(
                "_src", "x.budget", F.shiftleft("x.b", shift).alias("low"), (F.col("x.upto") - F.col("x.n")).alias("below"),
                F.when(F.lit(shift == 0) & (F.col("x.upto") - F.col("x.budget") < F.col("x.budget") - F.col("x.upto") + F.col("x.n")), F.shiftleft("x.b", shift) + 1).alias("above"),
            )
        )
        if shift:
            mark = at.select(F.col("_src").alias("_s"), F.shiftright("low", shift).alias("_b"))
            inside = stored(inside.join(bounded(mark, MAX_SOURCES), F.col("_src").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift) == F.col("_b")), "left_semi"))
            at = at.drop("above")
    return at.select("_src", F.coalesce("above", "low").alias("cut"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("_src"), F.size(words_of(text_of())).cast("long").alias("size"), order_hash(F.col("doc_id")).alias("h"))


def _plan(rows: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """One row for each source: _s, source_size, target, whole (how often all its documents are
    taken) and cut (below this hash they are taken once more). Stored."""
    spark = rows.sparkSession
    sizes = [(r["_src"], r["n"]) for r in rows.groupBy("_src").agg(F.sum("size").alias("n")).collect()]
    size_of, plan = dict(sizes), []
    for s, t in targets(sizes, weights, share, limit):
        whole = int(t // size_of[s]) if size_of[s] else 0
        plan.append((s, size_of[s], t, whole, t - whole * size_of[s]))
    plan = spark.createDataFrame(plan, "_src string, source_size long, target double, whole long, budget double")
    cuts = thresholds(rows.select("_src", "size", "h"), plan.select("_src", "budget")).withColumnRenamed("_src", "_s")
    return stored(plan.join(cuts, F.col("_src").eqNullSafe(F.col("_s")), "left").select(F.col("_src").alias("_s"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")))


def _times(h: Column) -> Column:
    return F.col("whole") + F.when(h < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs (doc_id, text, source).

    size is the number of words (0 for a null text), taken a multiple of it. Each source's taken
    words differ from its target by half of one document at most (rows with the same doc_id go
    together). Null is a source of its own. Reruns agree, as the order comes from the doc_id
    alone. The plan has one row for each source on the driver, as the caller gives a weight for
    each; all else stays on the executors.
    """
    rows = stored(_rows(docs))
    plan = _plan(rows, weights, share, limit)
    out = rows.join(bounded(plan, MAX_SOURCES), F.col("_src").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("h"))).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns."""
    plan = _plan(stored(_rows(docs)), weights, share, limit)
    # The row goes along as one column, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    out = rows.join(bounded(plan, MAX_SOURCES), F.col("_doc.source").cast("string").eqNullSafe(F.col("_s")))
    return out.withColumn("_times", F.explode(F.array_repeat(F.lit(1), _times(order_hash(F.col("_doc.doc_id"))).cast("int")))).select("_doc.*")
