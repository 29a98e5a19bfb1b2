"""Business-name joins without a nested loop.

Two names match when one normalised name is a whole-word prefix of the other, so
every match shares a key: the shorter name itself.  Names are exploded to their
prefixes (bounded by their word count) and joined on equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.functions.names import normalize_name, proper_prefixes


def _keyed(df: DataFrame, keys: list[str], norm: str) -> DataFrame:
    """Rows (keys, norm, _k, whole): the name itself and its proper prefixes."""
    every = F.concat(
        F.array(F.struct(F.col(norm).alias("_k"), F.lit(True).alias("whole"))),
        F.transform(proper_prefixes(F.col(norm)), lambda p: F.struct(p.alias("_k"), F.lit(False).alias("whole"))),
    )
    return df.select("*", F.inline(every))


def same_business_join(left: DataFrame, right: DataFrame, l_col: str, r_col: str, keys: list[str]) -> DataFrame:
    """All matching (left row, right row) pairs, each once. Columns of both sides
    must differ except for ``keys``."""
    l = left.withColumn("_ln", normalize_name(F.col(l_col))).filter(F.col("_ln") != "")
    r = right.withColumn("_rn", normalize_name(F.col(r_col))).filter(F.col("_rn") != "")
    lk = _keyed(l, keys, "_ln").withColumnRenamed("whole", "_lw")
    rk = _keyed(r, keys, "_rn").withColumnRenamed("whole", "_rw")
    # A pair meets exactly once: at the shorter name, where that side is whole.
    return lk.join(rk, [*keys, "_k"]).filter(F.col("_lw") | F.col("_rw")).drop("_k", "_lw", "_rw", "_ln", "_rn")


def first_match(
    names: DataFrame,
    targets: DataFrame,
    name_col: str,
    target_col: str,
    keys: list[str],
    ord_cols: list[str],
    payload: list[str],
    by: str | None = None,
    values: tuple[str, ...] = (),
) -> DataFrame:
    """For each distinct (keys, name): the payload of its first matching target. With
    ``by`` (a column of ``targets``) the first match per value, as ``<value>_<column>``.

    Both sides shrink before the join: names to distinct norms, targets to their
    first row per key, so copies of a hot name never meet each other."""
    n = names.select(*keys, name_col).distinct().withColumn("norm", normalize_name(F.col(name_col)))
    first = F.struct(*[F.col(c) for c in ord_cols], *[F.col(c) for c in payload if c not in ord_cols])
    kind = F.col(by) if by else F.lit("")
    t = targets.withColumns({"_tn": normalize_name(F.col(target_col)), "_kind": kind}).filter(F.col("_tn") != "")
    if by:
        t = t.filter(F.col("_kind").isin(list(values)))
    index = _keyed(t, keys, "_tn").groupBy(*keys, "_k", "whole", "_kind").agg(F.min(first).alias("hit"))
    probes = _keyed(n.select(*keys, "norm").distinct(), keys, "norm").withColumnRenamed("whole", "_own")
    picks = {v: F.min(F.when(F.col("_kind") == v, F.col("hit"))).alias(f"hit_{v}") for v in (values if by else ("",))}
    hits = (
        probes.join(index, [*keys, "_k"]).filter(F.col("_own") | F.col("whole")).groupBy(*keys, "norm").agg(*picks.values())
    )
    prefix = {v: f"{v}_" if by else "" for v in picks}
    return n.join(hits, [*keys, "norm"], "left").select(
        *keys, name_col, *[F.col(f"hit_{v}")[c].alias(prefix[v] + c) for v in picks for c in payload]
    )
