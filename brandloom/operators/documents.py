"""Document chunks, corpus budget and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brandloom.functions.text import chunk_text, clean_text, strip_tags
from brandloom.operators.topics import top_rows


def index_documents(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """``docs``: document_id, project_id, content. One row per chunk; no shuffle."""
    return docs.select("document_id", "project_id", F.posexplode(chunk_text(F.col("content"), size, overlap)).alias("chunk_index", "content"))


def document_text(docs: DataFrame) -> DataFrame:
    """``docs``: document_id, project_id, name, text. Cleans text and html; rows that
    hold no readable text, or an unsupported kind, get status ``error``."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    known = ext.isin("md", "markdown", "txt", "csv", "json", "html", "htm")
    body = clean_text(F.when(F.startswith(ext, F.lit("htm")), strip_tags(F.col("text"))).otherwise(F.col("text")))
    legacy = ext.isin("doc", "ppt")
    error = (
        F.when(legacy, F.concat(F.lit("Legacy ."), ext, F.lit(" files are not supported. Save as ."), ext, F.lit("x or PDF and re-upload.")))
        .when(~known, F.concat(F.lit("Unsupported file type: ."), ext))
        .when(F.coalesce(body, F.lit("")) == "", F.lit("No readable text found in this file (scanned PDFs need OCR first)."))
    )
    return docs.select(
        *[c for c in docs.columns if c != "text"], F.when(error.isNull(), body).alias("content"), error.alias("error"),
        F.when(error.isNull(), "ready").otherwise("error").alias("status"),
    )


def corpus_budget(docs: DataFrame, per_doc: int = 25_000, total: int = 90_000, newest: int = 20) -> DataFrame:
    """Newest ready documents of a project, cut to a shared character budget.
    ``docs``: project_id, document_id, content, status, created_at."""
    ready = docs.filter((F.col("status") == "ready") & (F.coalesce("content", F.lit("")) != ""))
    recent = top_rows(ready.withColumn("n_chars", F.length("content")), ["project_id"], [F.desc("created_at"), "document_id"], newest)
    want = F.least(F.lit(per_doc), F.col("n_chars"))
    w = Window.partitionBy("project_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(want).over(w), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(want, F.lit(total) - before)).cast("int")
    return recent.withColumn("taken", taken).filter(F.col("taken") > 0).withColumn("excerpt", F.col("content").substr(F.lit(1), F.col("taken")))
