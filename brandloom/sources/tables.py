"""Text documents in, Parquet tables out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brandloom.functions.regex import trim_ws
from brandloom.operators.documents import document_text
from brandloom.operators.keyed import upsert_latest


def read_text_documents(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Whole text, markdown, csv, json and html files as cleaned documents."""
    raw = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    docs = raw.select(F.input_file_name().alias("document_id"), F.lit(project_id).alias("project_id"), name.alias("name"), F.col("value").alias("text"))
    return document_text(docs)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the partitions (key values) present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_table(new: DataFrame, path: str, partition: str, keys: list[str], order: list[str]) -> None:
    """Merge rows into a partitioned table; only the touched partitions are read
    (a pruned scan) and rewritten. The merged rows are checkpointed first, because
    they are read from the folder they replace."""
    from brandloom.session import cut_lineage

    touched = new.select(partition).distinct()
    old = table_or_empty(new.sparkSession, path, new.schema).join(touched, partition, "left_semi").select(*new.columns)
    replace_by_key(cut_lineage(upsert_latest(old, new, keys, order)), path, [partition])


def replace_rows(new: DataFrame, path: str, bucket: str, key: str, touched: DataFrame, buckets: list[int]) -> None:
    """Replace all rows of the ``touched`` keys (columns bucket, key) by ``new``, which may hold none
    for some. ``buckets``: the buckets of these keys; only they are read and rewritten. Buckets
    that are left without rows are emptied."""
    from brandloom.session import cut_lineage

    spark = new.sparkSession
    old = table_or_empty(spark, path, new.schema).filter(F.col(bucket).isin(buckets)).join(touched, [bucket, key], "left_anti").select(*new.columns)
    merged = cut_lineage(old.unionByName(new))
    replace_by_key(merged, path, [bucket])
    filled = {r[0] for r in merged.select(bucket).distinct().collect()}  # as many as there are buckets, at most
    for b in sorted(set(buckets) - filled):
        merged.limit(0).drop(bucket).write.mode("overwrite").parquet(f"{path}/{bucket}={b}")


def save_results(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Nested result rows (briefs, plans, reports, summaries) as Parquet."""
    if keys:
        replace_by_key(df, path, keys)
    else:
        df.write.mode("overwrite").parquet(path)


def checked_input(df: DataFrame, required: dict[str, tuple[int, int]], optional: dict[str, int], enums: dict[str, list[str]], defaults: dict[str, str]) -> DataFrame:
    """Trimmed input with defaults, and the list of fields that break a rule.
    ``required``: field -> (min, max) length; ``optional``: field -> max length, empty
    becomes NULL; ``enums``: allowed values."""
    fields = {f: trim_ws(F.col(f)) for f in required} | {f: F.nullif(trim_ws(F.col(f)), F.lit("")) for f in optional}
    fields |= {f: F.coalesce(fields.get(f, F.col(f)), F.lit(v)) for f, v in defaults.items()}
    out = df.withColumns(fields)
    bad: list[Column] = [F.when(~F.coalesce(F.length(f).between(lo, hi), F.lit(False)), F.lit(f)) for f, (lo, hi) in required.items()]
    bad += [F.when(F.length(f) > hi, F.lit(f)) for f, hi in optional.items()]
    bad += [F.when(~F.col(f).isin(vs), F.lit(f)) for f, vs in enums.items()]
    return out.withColumn("violations", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
