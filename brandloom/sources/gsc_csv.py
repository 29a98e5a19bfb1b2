"""Search Console CSV exports: a distributed scan with tolerant headers and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import js_round, trim_ws

_PREFIX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def parse_number(text: Column) -> Column:
    """Leading number of a localised figure; anything else is 0."""
    bare = F.regexp_replace(text, "[%," + V.WS_CLASS[1:-1] + "]", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, _PREFIX, 0), F.lit("")).try_cast("double"), F.lit(0.0))


def parse_share(text: Column) -> Column:
    """Click rate: a percentage becomes a fraction; an empty cell has no value."""
    value = parse_number(text) / F.when(F.contains(text, F.lit("%")), 100.0).otherwise(1.0)
    return F.when(F.coalesce(text, F.lit("")) != "", value)


def resolve_headers(columns: list[str]) -> dict[str, str | None]:
    """Column name for each field: the first header that contains one of its names."""
    plain = [(c, c.lstrip("﻿").lower().strip()) for c in columns]
    return {f: next((c for c, p in plain if any(n in p for n in names)), None) for f, names in V.GSC_HEADERS.items()}


def _typed(cell: Callable[[str], Column], has_position: Column) -> list[Column]:
    """Typed fields of an export row from its text cells."""
    return [
        trim_ws(cell("query")).alias("query"), F.nullif(trim_ws(cell("page")), F.lit("")).alias("page"),
        js_round(parse_number(cell("clicks"))).alias("clicks"), js_round(parse_number(cell("impressions"))).alias("impressions"),
        parse_share(cell("ctr")).alias("ctr"), F.when(has_position, parse_number(cell("position"))).alias("position"),
    ]


def shape_gsc(raw: DataFrame, project_id: str, period_label: str | None = None) -> DataFrame:
    """Typed rows from a header-named text frame."""
    at = resolve_headers(raw.columns)
    if at["query"] is None:
        raise ValueError('CSV needs a "Query" / "Top queries" column')
    if at["page"] == at["query"]:
        at["page"] = None

    def cell(field: str) -> Column:
        return F.col(f"`{at[field]}`") if at[field] is not None else F.lit(None).cast("string")

    rows = raw.select(F.lit(project_id).alias("project_id"), *_typed(cell, F.lit(at["position"] is not None)), F.lit(period_label).cast("string").alias("period_label"))
    return rows.filter(F.coalesce("query", F.lit("")) != "")


def read_gsc(spark: SparkSession, path: str, project_id: str, period_label: str | None = None) -> DataFrame:
    """Scan one export (a file or a folder of files with the same header)."""
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False)
        .option("ignoreLeadingWhiteSpace", False).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    )
    return shape_gsc(raw, project_id, period_label)


# --- many exports of many projects -------------------------------------------------------

# A cell with the comma before it: quoted stretches may hold commas, and end with the line at the latest.
_CELL = r',((?:"[^"]*+(?:"|$)|[^,"]++)*+)'


def split_cells(line: Column) -> Column:
    """Cells of one CSV line, without their quotes; doubled quotes stand for one."""
    def bare(c: Column) -> Column:
        whole = F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(c, F.lit('"')), whole).otherwise(F.replace(c, F.lit('"'), F.lit("")))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1), bare)


def folder_name(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def file_stem(path: Column) -> Column:
    """Name of a file without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def header_catalogue(lines: DataFrame) -> DataFrame:
    """One row for each file: where its header stands (``head_at``), the header, and the place
    of each field in it from 0, or NULL. ``lines``: path, at (orders the lines of a file), line."""
    heads = lines.groupBy("path").agg(F.min(F.struct("at", "line")).alias("h"))
    cells = F.transform(split_cells(F.col("h.line")), lambda c: F.lower(trim_ws(F.replace(c, F.lit("\ufeff"), F.lit("")))))

    def place(names: list[str]) -> Column:
        named = F.transform("cells", lambda c: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n)))
        return F.nullif(F.array_position(named, True), F.lit(0)).cast("int") - 1

    at = heads.select("path", F.col("h.at").alias("head_at"), F.col("h.line").alias("header"), cells.alias("cells"))
    at = at.select("path", "head_at", "header", *[place(names).alias("at_" + f) for f, names in V.GSC_HEADERS.items()])
    return at.withColumn("at_page", F.when(~F.col("at_page").eqNullSafe(F.col("at_query")), F.col("at_page")))


def read_gsc_exports(
    spark: SparkSession, path: str, project_of: Callable[[Column], Column] = folder_name, period_of: Callable[[Column], Column] = file_stem,
) -> tuple[DataFrame, DataFrame]:
    """Scan the exports of many projects, each file with columns in its own order.

    Returns the typed rows (project_id, query, page, clicks, impressions, ctr, position,
    period_label) and the rejected files (path, header, reason). Project and period are taken from
    the path of a file: its folder and its name. A file without a query column is rejected whole;
    blank lines, rows without a query and files of a header alone give nothing. Lines are read in
    splits; a file's header reaches its rows by a join on the path, one narrow row for each file."""
    meta = F.col("_metadata")
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B"))).alias("path"),
        # Lines of a split are read in order, and the splits of a file by their begin.
        F.struct(meta["file_block_start"].alias("begin"), F.monotonically_increasing_id().alias("nth")).alias("at"), F.col("value").alias("line"),
    )
    lines = raw.filter(trim_ws(F.replace("line", F.lit("\ufeff"), F.lit(""))) != "")
    heads = header_catalogue(lines)
    known = heads.filter(F.col("at_query").isNotNull()).drop("header")
    rows = lines.join(known, "path").filter(F.col("at") != F.col("head_at")).withColumn("cells", split_cells(F.col("line")))
    typed = rows.select(
        project_of(F.col("path")).alias("project_id"), *_typed(lambda f: F.get("cells", F.col("at_" + f)), F.col("at_position").isNotNull()),
        period_of(F.col("path")).alias("period_label"),
    ).filter(F.coalesce("query", F.lit("")) != "")
    rejects = heads.filter(F.col("at_query").isNull()).select("path", "header", F.lit("no query column").alias("reason"))
    return typed, rejects
