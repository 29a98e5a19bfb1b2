"""Incremental jobs: streams of samples and edited drafts, one micro-batch at a time.

The tables a job keeps are a function of the rows it has seen, whatever batches they came in: a
newer row wins by its event time, rows of the same time by their content. So a batch that is
applied twice, or a stream that starts again with an empty checkpoint, gives the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brandloom.functions.lexicon import HOSPITALITY, Lexicon
from brandloom.operators.checks import check_drafts, score_drafts
from brandloom.operators.visibility import visibility_summary
from brandloom.session import cut_lineage
from brandloom.sources.tables import replace_by_key, replace_rows, table_or_empty, upsert_table

#: Runs and drafts are small; tables are partitioned by a hash bucket of their key
#: so that a micro-batch rewrites few, well-filled partitions.
BUCKETS = 64

LEDGER = "query_id string, batch_id long, rows long"


def in_buckets(df: DataFrame, key: str, n: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def digest(*cols: str) -> Column:
    """Digest of the values of columns, NULL and empty told apart."""
    return F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def bucket_list(touched: DataFrame) -> list[int]:
    """Buckets of a batch: no more than the tables have."""
    return sorted(r[0] for r in touched.select("bucket").distinct().collect())


def once(folder: str, apply: Callable[[DataFrame], int]) -> Callable[[DataFrame, int], None]:
    """Passes over the batches that the ledger of this query (``folder/ledger``) already names. A
    batch is entered after all its tables are written; one that was broken off is applied again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        path = f"{folder}/ledger"
        if not table_or_empty(spark, path, LEDGER).filter((F.col("query_id") == query) & (F.col("batch_id") == batch_id)).isEmpty():
            return
        rows = apply(batch)
        replace_by_key(spark.createDataFrame([(query, batch_id, rows)], LEDGER), path, ["query_id", "batch_id"])

    return run


SAMPLE_KEY = ["run_id", "prompt_index", "iteration"]


def visibility_stream(
    stream: DataFrame, folder: str, checkpoint: str, brands: DataFrame, plans: DataFrame, places: DataFrame,
    lexicon: Lexicon = HOSPITALITY, arrival: str = "arrived_at", buckets: int = BUCKETS,
) -> StreamingQuery:
    """Upserts arriving samples by key, then recomputes all results of the touched runs.

    Tables in ``folder``, by ``bucket``: samples, businesses, domains, per_prompt and summary (see
    ``visibility_summary``). Of the samples of a key the last by ``arrival`` stays; of equal
    arrivals the one with the largest digest. Samples without a run are left out."""

    def apply(batch: DataFrame) -> int:
        spark = batch.sparkSession
        rows = cut_lineage(in_buckets(batch.filter(F.col("run_id").isNotNull()).withColumn("digest", digest(*batch.columns)), "run_id", buckets))
        touched = rows.select("bucket", "run_id").distinct()
        at = bucket_list(touched)
        if not at:
            return 0
        upsert_table(rows, f"{folder}/samples", "bucket", SAMPLE_KEY, [arrival, "digest"])
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/samples").filter(F.col("bucket").isin(at))
        samples = kept.join(touched, ["bucket", "run_id"], "left_semi")
        runs = touched.select("run_id")
        out = visibility_summary(brands, plans.join(runs, "run_id", "left_semi"), places.join(runs, "run_id", "left_semi"), samples, lexicon)
        for name, frame in out.items():
            replace_rows(in_buckets(frame, "run_id", buckets), f"{folder}/{name}", "bucket", "run_id", touched, at)
        return rows.count()

    return stream.writeStream.foreachBatch(once(folder, apply)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DRAFT_STATE = "draft_id string, edited_at {at}, content_digest string, profile_digest string, seo long, geo long, brand long, conversion long, overall long, bucket int"


def profile_digests(brands: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Digest of all that the checks of a project's drafts read besides the draft."""
    own = brands.select("project_id", digest(*brands.columns).alias("b"))
    if rules is None:
        return own.select("project_id", F.col("b").alias("profile_digest"))
    held = rules.groupBy("project_id").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "content"))))).alias("r"))
    return own.join(held, "project_id", "left").select("project_id", F.concat_ws("-", "b", "r").alias("profile_digest"))


def recheck_stream(
    stream: DataFrame, prior: Callable[[], DataFrame] | None, folder: str, checkpoint: str, brands: DataFrame, rules: DataFrame | None = None, lexicon: Lexicon = HOSPITALITY,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Re-runs the checks of edited drafts. The entities an earlier report required
    (``prior``: draft_id, required_entities) stay required. ``stream``: draft_id,
    project_id, content, keyword, edited_at.

    Tables in ``folder``, by ``bucket``: checks (the report, a row for each check) and scores (with
    the time and the digests of what was checked). The last edit of a draft counts, of equal times
    the one with the largest digest; an edit that is not newer changes nothing. A draft is checked
    again only if its text, keyword, project or required entities changed, or its project's profile
    or rules: a batch without such a change writes neither table. Drafts of unknown projects have
    no report. Rows without a draft_id are left out."""

    def apply(batch: DataFrame) -> int:
        spark = batch.sparkSession
        edits = batch.filter(F.col("draft_id").isNotNull()).select(F.col("draft_id").cast("string").alias("draft_id"), "project_id", "content", "keyword", "edited_at")
        none = F.array().cast("array<string>")
        if prior is not None:
            known = prior().select(F.col("draft_id").cast("string").alias("draft_id"), "required_entities")
            edits = edits.join(known, "draft_id", "left").withColumn("required_entities", F.coalesce("required_entities", none))
        else:
            edits = edits.withColumn("required_entities", none)
        edits = edits.withColumn("content_digest", digest("project_id", "content", "keyword", "required_entities"))
        newest = edits.groupBy("draft_id").agg(F.max_by(F.struct(*[c for c in edits.columns if c != "draft_id"]), F.struct("edited_at", "content_digest")).alias("d")).select("draft_id", "d.*")
        newest = cut_lineage(in_buckets(newest.join(profile_digests(brands, rules), "project_id"), "draft_id", buckets))

        schema = DRAFT_STATE.format(at=newest.schema["edited_at"].dataType.simpleString())
        at = bucket_list(newest)
        held = table_or_empty(spark, f"{folder}/scores", schema).filter(F.col("bucket").isin(at))
        old = held.select("draft_id", F.struct("edited_at", "content_digest").alias("was"), F.col("profile_digest").alias("was_profile"))
        now = F.struct("edited_at", "content_digest")
        later = F.col("was").isNull() | (now > F.col("was"))
        other = F.col("was").isNull() | (F.col("content_digest") != F.col("was.content_digest"))
        profile = F.col("profile_digest") != F.col("was_profile")
        stale = (later & (other | profile)) | ((now == F.col("was")) & profile)
        seen = newest.join(old, "draft_id", "left").withColumn("stale", F.coalesce(stale, F.lit(False))).withColumn("later", later)
        work = cut_lineage(seen.filter(F.col("stale") | F.col("later")).drop("was", "was_profile", "later"))
        at = bucket_list(work)
        if not at:
            return 0
        touched = work.filter("stale").select("bucket", "draft_id")
        checks = cut_lineage(check_drafts(work.filter("stale").drop("stale", "bucket", "edited_at", "content_digest", "profile_digest"), brands, rules, lexicon))
        to_check = bucket_list(touched)
        if to_check:
            replace_rows(in_buckets(checks, "draft_id", buckets), f"{folder}/checks", "bucket", "draft_id", touched, to_check)
        # An edit without a change keeps its scores and takes the later time.
        scores = score_drafts(checks).unionByName(held.join(work.filter("not stale"), "draft_id", "left_semi").select("draft_id", "seo", "geo", "brand", "conversion", "overall"))
        state = work.select("draft_id", "edited_at", "content_digest", "profile_digest", "bucket").join(scores, "draft_id").select(*held.columns)
        replace_rows(state, f"{folder}/scores", "bucket", "draft_id", work.select("bucket", "draft_id"), at)
        return work.count()

    return stream.writeStream.foreachBatch(once(folder, apply)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
