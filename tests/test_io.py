import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from brandloom.operators.checks import check_drafts
from brandloom.operators.keyed import Reference, cascade_delete, clear_missing_parent, upsert_latest
from brandloom.operators.visibility import visibility_summary
from brandloom.plans.dashboards import project_overview, research_inputs
from brandloom.sources import serp_json as J
from brandloom.sources.gsc_csv import read_gsc, read_gsc_exports, resolve_headers, split_cells
from brandloom.sources.tables import checked_input, read_text_documents, replace_rows, upsert_table
from brandloom.streaming.jobs import recheck_stream, visibility_stream
from tests import fixtures as X


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_gsc_csv(spark):
    d = folder()
    with open(f"{d}/a.csv", "w", encoding="utf-8") as f:
        f.write('﻿Top queries,Clicks,Impressions,CTR,Position\n"anio hotel hoi an",120,900,13.3%,1.2\n\n"best boutique hotel, hoi an","1,002",1500.5,0.13%,14\n"say ""hi""",x,,,\n,1,1,1,1\n')
    rows = {r.query: r for r in read_gsc(spark, f"{d}/a.csv", "p").collect()}
    assert set(rows) == {"anio hotel hoi an", "best boutique hotel, hoi an", 'say "hi"'}
    assert abs(rows["anio hotel hoi an"].ctr - 0.133) < 1e-9
    b = rows["best boutique hotel, hoi an"]
    assert (b.clicks, b.impressions, b.page) == (1002, 1501, None)
    assert (rows['say "hi"'].clicks, rows['say "hi"'].ctr, rows['say "hi"'].position) == (0, None, 0.0)
    assert resolve_headers(["Landing URL", "Search query"])["page"] == "Landing URL"
    with open(f"{d}/b.csv", "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_gsc(spark, f"{d}/b.csv", "p")


def test_serp_json(spark):
    d = folder()
    doc = {
        "serp_id": "s", "project_id": "lis", "query": "q",
        "organic_results": [{"title": f"t{i}", "link": f"https://x/{i}"} for i in range(12)],
        "related_questions": [{"question": "Is it?"}], "related_searches": [{"query": "a"}, {"query": ""}],
        "local_results": {"places": [{"title": "P", "links": {"website": "w"}}, {"title": "Q", "position": 7}]},
        "ai_overview": {"text_blocks": [{"snippet": "one", "list": [{"snippet": "two"}]}, {"list": []}]},
        "answer_box": {"answer": "yes"},
    }
    other = {**doc, "serp_id": "t", "local_results": [{"title": "L"}], "answer_box": None, "ai_overview": None}
    with open(f"{d}/a.json", "w") as f:
        f.write(json.dumps(doc) + "\n" + json.dumps(other) + "\n")
    fr = J.serp_frames(J.read_json(spark, d))
    s = {r.serp_id: r for r in fr["serps"].collect()}
    assert s["s"].ai_overview == "one\n- two" and s["s"].answer_snippet == "yes" and s["s"].has_answer and not s["t"].has_answer
    assert fr["organic"].filter("serp_id = 's'").count() == 10 and fr["organic"].agg(F.max("position")).collect()[0][0] == 10
    p = [(r.serp_id, r.title, r.position, r.website) for r in fr["places"].orderBy("serp_id", "ord").collect()]
    assert p == [("s", "P", 1, "w"), ("s", "Q", 7, None), ("t", "L", 1, None)]
    assert fr["related"].count() == 2


def test_gsc_exports_of_many_projects(spark):
    d = folder()
    files = {
        "p one/may.csv": '\n\ufeffTop queries,Clicks,Impressions,CTR,Position\n"a, b","1,002",10,50%,1.5\nTop queries,Clicks,Impressions,CTR,Position\n',
        "p+2/june.2.csv": "Landing page,Query,Position\nhttps://x,q2,3\n,  ,1\n/y,q3,\n",
        "p+2/july.csv": "CTR,Impressions,Clicks,Search query URL\n0.2,7,3,q4\n",
        "p3/broken.csv": "a,b\n1,2\n", "p3/empty.csv": "", "p3/head.csv": "Query,Clicks\n",
    }
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        with open(f"{d}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    rows, rejects = read_gsc_exports(spark, d)
    got = {(r.project_id, r.period_label, r.query): (r.page, r.clicks, r.impressions, r.ctr, r.position) for r in rows.collect()}
    assert got == {
        ("p one", "may", "a, b"): (None, 1002, 10, 0.5, 1.5), ("p one", "may", "Top queries"): (None, 0, 0, 0.0, 0.0),
        ("p+2", "june.2", "q2"): ("https://x", 0, 0, None, 3.0), ("p+2", "june.2", "q3"): ("/y", 0, 0, None, 0.0),
        ("p+2", "july", "q4"): (None, 3, 7, 0.2, None),
    }
    assert [(r.path.split("/")[-1], r.header, r.reason) for r in rejects.collect()] == [("broken.csv", "a,b", "no query column")]
    lines = [",x", 'a,"b ""c"", d",', '""', '"open, end', "x" * 20_000]
    cells = spark.createDataFrame([(x,) for x in lines], "x string").select(split_cells(F.col("x"))).collect()
    assert [r[0] for r in cells] == [["", "x"], ["a", 'b "c", d', ""], [""], ["open, end"], ["x" * 20_000]]


def test_gsc_header_of_a_file_in_many_splits(spark):
    """The header is the first line of the file whichever split is read first."""
    d = folder()
    os.makedirs(f"{d}/p")
    with open(f"{d}/p/m.csv", "w") as f:
        f.write("Clicks,Query\n" + "".join(f"{i},q{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, rejects = read_gsc_exports(spark, d)
        assert spark.read.text(f"{d}/p").rdd.getNumPartitions() > 1 and rejects.count() == 0
        assert sorted((r.clicks, r.query) for r in rows.collect()) == [(i, f"q{i}") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_serp_rejects(spark):
    d = folder()
    with open(f"{d}/a.json", "w") as f:
        f.write('{"serp_id": "s", "query": "q", "related_searches": [{"query": "a"}]}\n\n{"serp_id": "cut", "query\n[1]\n{"query": "no key"}\n')
        f.write('{"serp_id": "t", "query": "q", "organic_results": "none", "related_searches": [{"query": "b"}]}\n')
    frames, rejects = J.read_serp(spark, d)
    assert sorted(r.serp_id for r in frames["serps"].collect()) == ["s", "t"]
    assert sorted((r.serp_id, r.text) for r in frames["related"].collect()) == [("s", "a"), ("t", "b")] and frames["organic"].count() == 0
    got = sorted((r.reason, r.record[:18]) for r in rejects.collect())
    assert got == [("no serp_id", '{"query": "no key"'), ("not JSON", '[1]'), ("not JSON", '{"serp_id": "cut", '[:18]), ("unexpected types", '{"serp_id": "t", "q'[:18])]


def test_reviews_and_forums(spark):
    r = spark.createDataFrame([("s", "P", [("T", "S", 4.0, "d", None), (None, None, None, None, ("orig",)), (None, None, None, None, None)])], f"serp_id string, place string, reviews array<{J.REVIEW}>")
    assert [x.text for x in J.map_reviews(r).orderBy("ord").collect()] == ["S", "orig"]
    assert [x.text for x in J.tripadvisor_reviews(r).collect()] == ["T — S"]
    f = spark.createDataFrame([("s", [(None, "T", "L", "sn", None, None, None, (("great",),))])], f"serp_id string, organic_results array<{J.RESULT}>")
    assert J.forum_posts(f).collect()[0].snippet == "sn | Top comment: great"


def test_text_documents(spark):
    d = folder()
    open(f"{d}/a.md", "w").write("# T\r\n\n\n\nBody  \n")
    open(f"{d}/b.html", "w").write("<p>Hi</p>")
    open(f"{d}/c.doc", "w").write("x")
    got = {r.name: r for r in read_text_documents(spark, d, "p").collect()}
    assert got["a.md"].content == "# T\n\nBody" and got["b.html"].content == "Hi" and got["c.doc"].status == "error"


def test_upsert_and_parents(spark):
    old = spark.createDataFrame([("r", 0, 0, "a", 1), ("r", 0, 1, "b", 1)], "run_id string, prompt_index int, iteration int, v string, t int")
    new = spark.createDataFrame([("r", 0, 0, "c", 2), ("q", 0, 0, "d", 2)], old.schema)
    got = {(r.run_id, r.iteration): r.v for r in upsert_latest(old, new, ["run_id", "prompt_index", "iteration"], ["t"]).collect()}
    assert got == {("r", 0): "c", ("r", 1): "b", ("q", 0): "d"}
    path = folder() + "/t"
    for batch in (old, new, new):
        upsert_table(batch, path, "run_id", ["run_id", "prompt_index", "iteration"], ["t"])
    assert {(r.run_id, r.iteration): r.v for r in spark.read.parquet(path).collect()} == got
    child = spark.createDataFrame([(1, 10), (2, 99)], "id int, fk int")
    assert {r.id: r.fk for r in clear_missing_parent(child, spark.createDataFrame([(10,)], "pk int"), "fk", "pk").collect()} == {1: 10, 2: None}


def test_cascades(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "projects": make([("a",), ("b",)], "project_id string"),
        "research_runs": make([(1, "a"), (2, "b"), (3, "b"), (4, None)], "run_id int, project_id string"),
        "visibility_samples": make([(1, "x"), (2, "y"), (2, "z"), (3, "w"), (None, "n")], "run_id int, v string"),
        "documents": make([(10, "a"), (20, "b")], "document_id int, project_id string"),
        "document_chunks": make([(10, "a", 0), (20, "b", 0), (20, "b", 1)], "document_id int, project_id string, i int"),
        "content_drafts": make([(7, "a"), (8, "b")], "draft_id int, project_id string"),
        "feedback_logs": make([("f", 7, "b"), ("g", 8, "b"), ("h", 8, "a"), ("i", None, "b"), ("j", 99, "b")], "id string, draft_id int, project_id string"),
    }

    def left(gone):
        return {t: sorted((tuple(r) for r in df.collect()), key=repr) for t, df in cascade_delete(tables, gone).items()}

    whole = left({"projects": make([], "project_id string")})
    assert whole == {t: sorted((tuple(r) for r in df.collect()), key=repr) for t, df in tables.items()}
    by_project = left(make([("a",), ("a",), (None,)], "project_id string"))
    assert by_project["projects"] == [("b",)] and by_project["research_runs"] == [(2, "b"), (3, "b"), (4, None)]
    assert by_project["visibility_samples"] == [(2, "y"), (2, "z"), (3, "w"), (None, "n")] and by_project["document_chunks"] == [(20, "b", 0), (20, "b", 1)]
    assert by_project["feedback_logs"] == [("f", None, "b"), ("g", 8, "b"), ("i", None, "b"), ("j", 99, "b")]
    one = left({"research_runs": make([(2,)], "run_id int"), "documents": make([(20,)], "document_id int"), "content_drafts": make([(8,)], "draft_id int")})
    assert one["research_runs"] == [(1, "a"), (3, "b"), (4, None)] and one["visibility_samples"] == [(1, "x"), (3, "w"), (None, "n")]
    assert one["documents"] == [(10, "a")] and one["document_chunks"] == [(10, "a", 0)] and one["projects"] == whole["projects"]
    assert one["content_drafts"] == [(7, "a")] and [r[:2] for r in one["feedback_logs"]] == [("f", 7), ("g", None), ("h", None), ("i", None), ("j", 99)]
    with pytest.raises(ValueError):
        cascade_delete(tables, make([], "project_id string"), (Reference("projects", "project_id", "documents"), Reference("documents", "project_id", "projects")))


def test_checked_input(spark):
    df = spark.createDataFrame([(" n ", "", "x"), ("", "abc", None)], "name string, note string, kind string")
    got = checked_input(df, {"name": (1, 5)}, {"note": 2}, {"kind": ["x"]}, {"kind": "x"}).collect()
    assert (got[0].name, got[0].note, got[0].violations) == ("n", None, []) and got[1].violations == ["name", "note"] and got[1].kind == "x"


def table_rows(spark, path, *drop):
    """Sorted rows of a stored table, whatever the order of its columns."""
    df = spark.read.parquet(path)
    return sorted((str(tuple(r)) for r in df.select(*sorted(set(df.columns) - set(drop))).collect()))


VISIBILITY_TABLES = ("samples", "businesses", "domains", "per_prompt", "summary")


def test_visibility_stream(spark):
    d = folder()
    s = X.samples(spark).withColumn("arrived_at", F.lit(1))
    s.write.parquet(f"{d}/in/1")

    def run(to, checkpoint):
        visibility_stream(spark.readStream.schema(s.schema).parquet(f"{d}/in/*"), to, checkpoint, X.brands(spark), X.plans(spark), X.places(spark), buckets=4).awaitTermination(300)

    run(d, f"{d}/cp")
    assert spark.read.parquet(f"{d}/summary").collect()[0].successful_samples == 4
    fixed = s.filter("iteration = 0 and prompt_index = 1").withColumn("iteration", F.lit(2)).withColumn("arrived_at", F.lit(2))
    fixed.write.parquet(f"{d}/in/2")
    run(d, f"{d}/cp")
    r = spark.read.parquet(f"{d}/summary").collect()
    assert len(r) == 1 and (r[0].total_samples, r[0].successful_samples) == (5, 5)
    assert len(table_rows(spark, f"{d}/ledger")) == 2

    # All frames equal one analysis of the newest samples, before and after an empty checkpoint reads all again.
    stored = {t: table_rows(spark, f"{d}/{t}") for t in VISIBILITY_TABLES}
    whole = visibility_summary(X.brands(spark), X.plans(spark), X.places(spark), spark.read.parquet(f"{d}/samples"))
    for name, frame in whole.items():
        assert sorted(str(tuple(x)) for x in frame.select(*sorted(frame.columns)).collect()) == table_rows(spark, f"{d}/{name}", "bucket"), name
    run(d, f"{d}/cp2")
    assert {t: table_rows(spark, f"{d}/{t}") for t in VISIBILITY_TABLES} == stored


def test_replace_rows_touches_its_buckets_alone(spark):
    path = folder() + "/t"
    schema = "k int, v string, bucket int"
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 2), (3, "d", 2), (4, "e", 3)], schema)
    replace_rows(first, path, "bucket", "k", first.select("bucket", "k").distinct(), [1, 2, 3])
    before = set(os.listdir(f"{path}/bucket=3"))
    touched = spark.createDataFrame([(1, 1), (2, 2)], "bucket int, k int")
    replace_rows(spark.createDataFrame([(2, "x", 2)], schema), path, "bucket", "k", touched, [1, 2])
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).select("k", "v", "bucket").collect()) == [(2, "x", 2), (3, "d", 2), (4, "e", 3)]
    assert set(os.listdir(f"{path}/bucket=3")) == before


def test_research_inputs_and_overview(spark):
    local = json.dumps({"ai": {"customer_questions": [{"question": "q1"}], "content_angles": ["a1"]}})
    vis = json.dumps({"brand": {"ai_mention_rate": 0.5}, "businesses": [{"name": "B"}], "citation_domains": [{"domain": "d"}]})
    runs = spark.createDataFrame(
        [("boat", "1", "local_context", "done", local, 1, None), ("boat", "2", "ai_visibility", "done", vis, 2, 0.5), ("boat", "3", "ai_visibility", "running", None, 3, None)],
        "project_id string, run_id string, kind string, status string, summary string, created_at int, brand_rate double",
    )
    r = research_inputs(runs).collect()[0]
    assert r.customer_questions == ["q1"] and r.content_angles == ["a1"] and r.ai_visibility[0].leaders == ["B"]
    none = spark.createDataFrame([], "project_id string, document_id string")
    drafts = spark.createDataFrame([("boat", "d", 80)], "project_id string, draft_id string, overall int")
    fb = spark.createDataFrame([("boat", True)], "project_id string, apply_as_rule boolean")
    o = {x.project_id: x for x in project_overview(X.brands(spark), none, drafts, fb, runs, none, none).collect()}["boat"]
    assert o.avg_score == 80 and o.visibility_rate == 0.5 and [s.done for s in o.steps] == [True, True, True, False, False, True, True, True]


def test_recheck_stream(spark):
    d = folder()
    edits = X.drafts(spark).drop("required_entities").withColumn("edited_at", F.lit(1))
    swapped = edits.filter("draft_id = 'faulty'").withColumn("content", F.lit(X.SOUND)).withColumn("edited_at", F.lit(2))
    edits.write.parquet(f"{d}/in/1")
    prior = lambda: X.drafts(spark).select("draft_id", "required_entities")

    def run(checkpoint="cp"):
        recheck_stream(spark.readStream.schema(edits.schema).parquet(f"{d}/in/*"), prior, d, f"{d}/{checkpoint}", X.brands(spark), buckets=4).awaitTermination(300)

    def files():
        return {t: sorted(f for _, _, fs in os.walk(f"{d}/{t}") for f in fs) for t in ("checks", "scores")}

    run()
    first = {r.draft_id: r.overall for r in spark.read.parquet(f"{d}/scores").collect()}
    assert first["faulty"] < 50 < first["sound"]
    swapped.write.parquet(f"{d}/in/2")
    run()
    second = {r.draft_id: r.overall for r in spark.read.parquet(f"{d}/scores").collect()}
    assert second == {"faulty": first["sound"], "sound": first["sound"]}
    latest = X.drafts(spark).withColumn("content", F.lit(X.SOUND))
    report = check_drafts(latest, X.brands(spark))
    want = sorted(str(tuple(r)) for r in report.select(*sorted(report.columns)).collect())
    assert table_rows(spark, f"{d}/checks", "bucket") == want

    # The same edits again, and older ones, write nothing; a later time alone leaves the report.
    before = files()
    swapped.unionByName(edits.filter("draft_id = 'faulty'")).write.parquet(f"{d}/in/3")
    run()
    assert files() == before
    swapped.withColumn("edited_at", F.lit(5)).write.parquet(f"{d}/in/4")
    run()
    assert files()["checks"] == before["checks"] and {r.draft_id: r.edited_at for r in spark.read.parquet(f"{d}/scores").collect()} == {"faulty": 5, "sound": 1}
    edits.filter("draft_id = 'faulty'").withColumn("edited_at", F.lit(4)).write.parquet(f"{d}/in/5")
    run()
    assert {r.draft_id: r.overall for r in spark.read.parquet(f"{d}/scores").collect()} == second
    run("cp2")
    assert table_rows(spark, f"{d}/checks", "bucket") == want and files()["checks"] == before["checks"]
