"""Key-based table maintenance: latest per key, cascades, predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both, keeping the row with the highest ``order`` per key. Rows of
    ``new`` win over rows of ``old`` with equal order. One combinable aggregation."""
    cols = old.columns
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.select(*cols).withColumn("_batch", F.lit(1)))
    rank = F.struct(*[F.col(c) for c in order], F.col("_batch"))
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys]), rank).alias("r"))
    return picked.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in cols])


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to the key of ``parent``; what becomes of a child row whose parent
    row is deleted: it goes too, or loses the reference."""

    child: str
    column: str
    parent: str
    set_null: bool = False


#: Key column of the tables that others refer to.
TABLE_KEYS = {"projects": "project_id", "documents": "document_id", "content_drafts": "draft_id", "research_runs": "run_id"}
REFERENCES = (
    *[
        Reference(child, "project_id", "projects") for child in (
            "documents", "document_chunks", "feedback_logs", "content_drafts", "research_runs", "gsc_queries", "content_briefs", "opportunity_reports",
        )
    ],
    Reference("document_chunks", "document_id", "documents"),
    Reference("visibility_samples", "run_id", "research_runs"),
    Reference("feedback_logs", "draft_id", "content_drafts", set_null=True),
)


def cascade_delete(
    tables: dict[str, DataFrame], deleted: DataFrame | dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES, keys: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables without the deleted rows and all that hangs on them.

    ``deleted``: key frames by table (one frame alone: projects). Sets of deleted keys are pushed
    along the references, parents first: a table's set holds the keys given for it and the keys of
    its rows whose parents go. References that are set to NULL lose the keys of deleted rows only.
    A missing reference or key keeps its row, repeated keys count once, and references to tables
    that are not given or lack the column are passed over. A circle of references is an error."""
    keys = keys or TABLE_KEYS
    given = deleted if isinstance(deleted, dict) else {"projects": deleted}
    held = [r for r in references if r.child in tables and (r.parent in tables or r.parent in given) and r.column in tables[r.child].columns]
    order = TopologicalSorter({t: {r.parent for r in held if r.child == t} for t in {*tables, *given}}).static_order()
    gone: dict[str, DataFrame] = {}
    out = dict(tables)
    for name in order:
        up = [r for r in held if r.child == name and r.parent in gone]
        cascades = [r for r in up if not r.set_null]
        sets = [given[name].select(keys[name])] if name in given else []
        if name in tables:
            rows = tables[name]
            ends = [(r.column, gone[r.parent].toDF(r.column)) for r in cascades]
            if name in keys:
                sets += [rows.join(k, c, "left_semi").select(keys[name]) for c, k in ends]
            for c, k in ends + [(keys[name], s) for s in sets[:1] if name in given]:
                rows = rows.join(k, c, "left_anti")
            for r in up:
                if r.set_null:
                    rows = _cleared(rows, r.column, gone[r.parent])
            out[name] = rows.select(*tables[name].columns)
        if sets and name in keys:
            gone[name] = reduce(DataFrame.union, sets).filter(F.col(keys[name]).isNotNull()).distinct()
    return out


def _cleared(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``column`` set to NULL where it holds a deleted key."""
    marked = rows.join(gone.toDF(column).withColumn("_gone", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def clear_missing_parent(child: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Sets the reference to NULL where the parent row is gone."""
    alive = parents.select(F.col(pk).alias(fk), F.lit(True).alias("_alive"))
    j = child.join(alive, fk, "left")
    return j.select(*[F.when(F.col("_alive"), F.col(c)).alias(c) if c == fk else F.col(c) for c in child.columns])


def orphans(child: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows that refer to no parent: the missing-project check."""
    return child.join(parents.select(F.col(pk).alias(fk)), fk, "left_anti")


def eq(col: str, value) -> Column:
    return F.col(col).cast("string") == F.lit(str(value))


def neq(col: str, value) -> Column:
    """Unequal as text; rows without a value are kept."""
    return ~F.col(col).cast("string").eqNullSafe(F.lit(str(value)))


def one_of(col: str, values: list) -> Column:
    return F.col(col).cast("string").isin([str(v) for v in values])


def any_eq(pairs: list[tuple[str, object]]) -> Column:
    test = F.lit(False)
    for c, v in pairs:
        test = test | F.coalesce(eq(c, v), F.lit(False))
    return test


def read_table(df: DataFrame, filters: list[Column] = (), order: list[tuple[str, bool]] = (), limit: int | None = None, ord_col: str | None = None) -> DataFrame:
    """Filtered, ordered, limited read. Ties keep input order through ``ord_col``."""
    for f in filters:
        df = df.filter(f)
    if order:
        by = [F.asc(c) if asc else F.desc(c) for c, asc in order]
        df = df.orderBy(*by, *([F.asc(ord_col)] if ord_col else []))
    return df.limit(limit) if limit is not None else df


def with_count(parents: DataFrame, child: DataFrame, pk: str, fk: str, name: str) -> DataFrame:
    """Adds the number of child rows per parent."""
    n = child.groupBy(F.col(fk).alias(pk)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, pk, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def touch(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.current_timestamp())
