import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brandloom.operators import checks as C
from brandloom.operators import gsc, questions, retrieval, reviews, setjoin, visibility
from brandloom.functions import text as T
from brandloom.operators.brands import brand_topics
from brandloom.operators.entities import extract_entities
from brandloom.operators.leaders import leader_clusters
from brandloom.operators.names import first_match, same_business_join
from brandloom.operators.phrases import phrase_matches
from brandloom.plans import brief, content_plan, dashboards, serp
from tests import fixtures as X


def test_visibility(spark):
    out = visibility.visibility_summary(X.brands(spark), X.plans(spark), X.places(spark), X.samples(spark))
    b = {r.name: r for r in out["businesses"].collect()}
    s = out["summary"].collect()[0]
    assert (s.total_samples, s.successful_samples) == (5, 4)
    brand = b["Copper Kettle Tea Rooms"]
    assert brand.role == "brand" and brand.ai_samples == 3 and abs(brand.ai_mention_rate - 3 / 4) < 1e-9
    assert (brand.gap, brand.maps_rank, brand.local_pack_rank) == ("both", 3, 1)
    assert s.brand.name == brand.name
    assert (b["Magpie Lane Bakery"].role, b["Magpie Lane Bakery"].gap) == ("competitor", "ai_only")
    assert b["Harbour Scones"].gap == "serp_only"
    assert set(b) == {"Copper Kettle Tea Rooms", "Magpie Lane Bakery", "Harbour Scones", "Whitby Fudge Shop", "Abbey Steps Cafe"}
    kinds = {r.domain: r.kind for r in out["domains"].collect()}
    assert kinds["copperkettle.example"] == "brand site" and kinds["booking.com"] == "OTA"
    assert [r.brand_rate for r in out["per_prompt"].orderBy("prompt_index").collect()] == [0.5, 1.0]
    # 3 + 1 + 2 + 1 names in four answers; one answer names the brand twice, which counts once
    assert abs(s.avg_mentions_per_answer - 6 / 4) < 1e-9 and abs(s.brand_share_of_voice - 3 / 6) < 1e-9


def test_gsc(spark):
    rows = [
        ("tea", 0, "copper kettle whitby opening hours", None, 50, 400, 0.125, 1.1),
        ("tea", 1, "which tea room in whitby allows dogs", None, 3, 700, 0.0043, 8.2),
        ("tea", 2, "copper kettle or magpie lane bakery", None, 2, 90, 0.022, 3.6),
        ("tea", 3, "cream tea whitby", None, 4, 2100, 0.0019, 12.7),
    ]
    df = spark.createDataFrame(rows, "project_id string, ord int, query string, page string, clicks long, impressions long, ctr double, position double")
    got = {r.ord: r for r in gsc.classify_gsc(df, X.brands(spark)).collect()}
    assert [got[k].pillar for k in range(3)] == ["company", "customers", "competitors"]
    assert "question" in got[1].signals and got[1].tail == "long"
    assert "striking distance" in got[3].signals


def test_content_plan(spark):
    rows = [
        ("boat", 0, "nidelva boathouse trondheim parking", None, 2, 300, 0.0067, 2.4, "company", ["branded", "low CTR for position"], "long", 40),
        ("boat", 1, "things to do near kristiansten fortress", None, 3, 1200, 0.0025, 11.5, "customers", ["striking distance"], "long", 80),
    ]
    opps = spark.createDataFrame(
        rows, "project_id string, ord int, query string, page string, clicks long, impressions long, ctr double, position double, pillar string, signals array<string>, tail string, score long"
    )
    plan = content_plan.content_plan(opps, X.brands(spark)).orderBy("rank").collect()
    assert [r.action for r in plan] == ["local_guide", "title_meta_rewrite"]
    assert plan[0].title.startswith("Local")
    assert plan[1].brand_facts_to_use == ["Free parking behind the smokehouse"]
    s = content_plan.plan_summary(opps, content_plan.content_plan(opps, X.brands(spark))).collect()[0]
    assert (s.queries, s.company, s.customers, s.competitors, s.briefs) == (2, 1, 1, 0, 2)


def test_serp_and_brief(spark):
    ins = serp.analyse_serp(X.brands(spark), X.serp(spark))
    r = ins.collect()[0]
    assert r.intent.primary == "Commercial investigation"
    assert r.serp_features == ["Local pack", "People Also Ask", "Discussions & forums", "Related searches"]
    names = [e.name for e in r.top_entities]
    assert any("Kristiansten Fortress" in n for n in names) and "Trondheim" not in names and "Nidelva Boathouse" not in names, names
    assert {f.format for f in r.content_formats} >= {"OTA listing", "Forum thread"}
    gaps = {g.topic: g for g in r.missing_opportunities}
    assert {"breakfast", "parking"} <= set(gaps), gaps
    assert gaps["parking"].brand_can_answer is True
    q = r.customer_questions
    assert len(q) >= 3 and any(x.sources[0] == "People Also Ask" for x in q[1:])
    toddlers = q[0]  # asked twice, so it comes first
    assert "toddlers" in toddlers.question and toddlers.sources == ["Forums", "Reddit"] and toddlers.frequency == "High" and toddlers.intent.startswith("Family travel")
    assert r.brand_presence.local_pack == 1 and r.brand_presence.organic is None
    comp = {c.name: c for c in r.competitors}
    assert list(comp)[:2] == ["Lerkendal Lodge", "Solsiden Pensjonat"] and "Fjordgata Rooms" in comp
    assert comp["Solsiden Pensjonat"].maps_rank == 1 and comp["Lerkendal Lodge"].rating == 3.9
    assert comp["Lerkendal Lodge"].weaknesses and comp["Lerkendal Lodge"].opportunity.startswith("Explain Nidelva Boathouse Trondheim's advantage on")
    assert r.review_themes.reviews == 3 and r.brand_review_themes.reviews == 1
    assert len(r.recommendations) >= 3 and r.recommendations[-1].title == "Position against Lerkendal Lodge"

    topics = spark.createDataFrame([("boat", "p7", "Best things to do in Trondheim")], "project_id string, serp_id string, topic string")
    b = brief.build_briefs(topics, X.brands(spark), ins, 2031).collect()[0]
    assert any("Famil" in a for a in b.audience)
    assert any("Kristiansten Fortress" in x.detail for x in b.brand_integration)
    assert len(b.internal_links) >= 1
    heads = [o.heading for o in b.outline]
    assert heads[0] == "Quick answer" and "FAQs" in heads and heads[-1] == "Call to action"
    assert "Trondheim" in b.title_ideas[0] and "2031" in b.title_ideas[0]
    assert len(b.meta_description) <= 158


def test_checks(spark):
    rules = spark.createDataFrame([("boat", 1, 'Never call us a "motel"')], "project_id string, rank int, content string")
    checks = C.check_drafts(X.drafts(spark), X.brands(spark), rules)
    rows = checks.collect()
    st = {(r.draft_id, r.check_id): r.status for r in rows}
    want = {
        "faulty": {"kw-h1": "pass", **dict.fromkeys(("brand-claims", "brand-avoid", "brand-names", "cta", "geo-where", "entities", "internal-links"), "fail"),
                   **dict.fromkeys(("brand-competitors", "brand-figures", "brand-english"), "warn")},
        "sound": dict.fromkeys(("kw-h1", "brand-claims", "brand-avoid", "brand-names", "brand-competitors", "brand-figures", "brand-english", "brand-vocab", "geo-where", "geo-why",
                                "geo-audience", "geo-faq", "cta", "internal-links", "entities"), "pass"),
    }
    assert {d: {c: st[d, c] for c in w} for d, w in want.items()} == want
    detail = {r.check_id: r.detail for r in rows if r.draft_id == "faulty"}
    assert "Bothouse" in detail["brand-names"] and "carbon-neutral" in detail["brand-claims"] and "Lerkendal Lodge" in detail["brand-competitors"]
    scores = {r.draft_id: r for r in C.score_drafts(checks).collect()}
    assert scores["faulty"].overall < 50 and scores["sound"].overall > scores["faulty"].overall + 30
    digest = {r.draft_id: r.issues for r in C.failed_checks(checks).collect()}
    assert "[brand] Restricted claims" in digest["faulty"]


def test_failed_checks_counts_areas_in_one_pass(spark):
    from brandloom.workload.draft_queries import open_issues

    checks = C.check_drafts(X.drafts(spark), X.brands(spark))
    want = Counter((r.draft_id, r.area) for r in checks.collect() if r.status != "pass")
    got = C.failed_checks(checks, ("seo", "conversion")).collect()
    assert {(r.draft_id, a): r[a] for r in got for a in ("seo", "conversion") if r[a]} == {k: n for k, n in want.items() if k[1] in ("seo", "conversion")}
    plan = open_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1  # the drafts are checked once


def test_checks_compute_only_what_they_read(spark):
    plan = C.check_drafts(X.drafts(spark), X.brands(spark), areas=("seo",)).select("draft_id", "check_id", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert not [c for c in ("name_tokens", "sent_folds", "para_folds", "plain_view") if f"AS {c}#" in plan]


def test_name_variants(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    official, aliases = ["Orre Orre", "Thatin", "Grand Copper Kettle Rooms"], [["orre erre"], None, []]
    pool = ["Orre", "orre", "Örre", "ore", "orrE.", "ore...", "...", "Thatin", "thatim", "hatin", "THATINS.", "thètin", "xhatix", "Grand", "grant", "Coper", "Kettle", "Rooms", "room.", "a-b"]
    rows = [(i, o, a, [rng.choice(pool) for _ in range(rng.randint(0, 40))]) for i in range(40) for o, a in zip(official, aliases)]
    near = lambda t: t[:-1] + rng.choice("xyz")
    rows += [(99, official[2], [], [near("Grand"), "Copper", near("Kettle"), "Rooms.", "Grand", "Copper", "Kettle", "Rooms"])]
    df = spark.createDataFrame(rows, "i int, o string, a array<string>, toks array<string>")
    joined = T.fold(F.array_join("toks", " "))
    folds, ends = F.split(joined, " "), F.split(F.regexp_replace(joined, r"[.,;:!?)]+(?= |\z)", ""), " ")
    df = df.withColumns({"folds": folds, "ends": ends})
    got = df.select("*", C.name_variants(F.col("o"), F.col("a"), "Brand", F.col("toks"), F.col("folds"), F.col("ends")).alias("v")).collect()
    plain = lambda x: x.lower().replace("ö", "o").replace("è", "e")
    for r in got:
        n, t, want = len(r.o.split()), r.o.lower(), []
        for k in range(len(r.toks) - n + 1):
            g = re.sub(r"[.,;:!?)]+$", "", " ".join(r.toks[k : k + n]))
            if plain(g) != t and plain(g) not in (r.a or []) and distance(plain(g), t) <= max(1, len(t) // 8):
                want.append(f"Brand: “{g}” → “{r.o}”")
        assert r.v == want
    assert sum(len(r.v) for r in got) > 20


def test_reviews(spark):
    rows = [("x", 0, 5.0, "We loved the breakfast basket, it was excellent."), ("x", 1, 2.0, "It was noisy all night.")]
    t = reviews.review_themes(spark.createDataFrame(rows, "k string, ord int, rating double, text string"), ["k"]).collect()
    assert ("breakfast", 1) in {(r.topic, r.polarity) for r in t} and ("noise", -1) in {(r.topic, r.polarity) for r in t}
    assert ("rooms", -1) not in {(r.topic, r.polarity) for r in t}


def test_review_targets(spark):
    subjects = spark.createDataFrame([("s", "Copper Kettle", ["Magpie Lane", "Harbour Scones", "Abbey Steps"]), ("t", "Copper Kettle", None)], "serp_id string, brand_name string, competitor_names array<string>")
    places = [
        ("s", "maps", 0, "Magpie Lane Bakery", "m0"), ("s", "maps", 1, "Copper Kettle Tea Rooms", "m1"), ("s", "maps", 2, "Copper Kettle", "m2"),
        ("s", "tripadvisor", 0, "Copper Kettle", ""), ("s", "tripadvisor", 1, "Abbey Steps", "t1"), ("s", "local_pack", 0, "Harbour Scones", "x"),
    ]
    places = spark.createDataFrame(places, "serp_id string, list string, ord int, title string, ref string")
    looked = [("s", "Harbour Scones", "maps", 0, "The Pier", "l0"), ("s", "Harbour Scones", "tripadvisor", 0, "The Pier", "l1"), ("s", "Magpie Lane", "maps", 0, "Magpie Lane", "l2"), ("t", "Copper Kettle", "tripadvisor", 3, "Copper Kettle Cafe", "l3")]
    looked = spark.createDataFrame(looked, "serp_id string, name string, list string, ord int, title string, ref string")
    got = {(r.serp_id, r.target, r.source, r.title, r.ref) for r in reviews.review_targets(subjects, places, ["serp_id"]).collect()}
    assert got == {("s", 0, "Google", "Copper Kettle Tea Rooms", "m1"), ("s", 1, "Google", "Magpie Lane Bakery", "m0")}
    targets = reviews.review_targets(subjects, places, ["serp_id"], looked)
    more = {(r.serp_id, r.target, r.source, r.title, r.ref) for r in targets.collect()}
    assert more - got == {("s", 2, "Google", "The Pier", "l0"), ("t", 0, "Tripadvisor", "Copper Kettle Cafe", "l3")} and got < more
    texts = [("s", "Google", "The Pier", 0, 5.0, "fine"), ("s", "Google", "The Pier", 1, 4.0, "fine"), ("s", "Tripadvisor", "The Pier", 0, 1.0, "no"), ("t", "Google", "The Pier", 0, 1.0, "no")]
    texts = spark.createDataFrame(texts, "serp_id string, source string, place string, ord int, rating double, text string")
    assert [tuple(r) for r in reviews.chosen_reviews(targets, texts, ["serp_id"]).collect()] == [("s", "Google", "The Pier", 2, 0, 5.0, "fine")]


def test_ten_places_of_a_list_from_zero(spark):
    """The reader counts places from 0: the eleventh stays out."""
    profiles = visibility.run_profiles(X.plans(spark), X.brands(spark))
    run = profiles.first().run_id
    kind = dict(X.plans(spark).dtypes)["run_id"]
    rows = spark.range(11).select(F.lit(run).cast(kind).alias("run_id"), F.lit("maps").alias("list"), F.col("id").alias("ord"), F.concat(F.lit("Place number "), F.col("id").cast("string")).alias("title"))
    names = {r.name for r in visibility.named_businesses(X.samples(spark), profiles, rows).collect()}
    assert {f"Place number {k}" for k in range(10)} <= names and "Place number 10" not in names


def test_questions(spark):
    rows = [("a", 0, "Does Trondheim suit toddlers in winter?", "Reddit", 1), ("a", 1, "does trondheim suit toddlers in the winter", "People Also Ask", 2), ("a", 2, "Trondheim cabins", "Related searches", 1)]
    df = spark.createDataFrame(rows, "k string, ord int, text string, source string, weight int")
    got = questions.merge_questions(df, ["k"]).collect()
    assert len(got) == 1 and got[0].frequency == "High" and got[0].intent.startswith("Family travel")


def test_entities(spark):
    docs = ["We walked from Kristiansten Fortress to Korsvika Beach", "Korsvika Beach is stony. Kristiansten Fortress is windy.", "a market in Trondheim"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(docs)], "k string, ord int, text string")
    ctx = spark.createDataFrame([("a", ["Trondheim", "Norway"], [], [])], "k string, exclude array<string>, exclude_businesses array<string>, businesses array<string>")
    got = {r.name: r.type for r in extract_entities(df, ["k"], ctx).collect()}
    assert {"Korsvika Beach", "Kristiansten Fortress"} <= set(got) and "Trondheim" not in got and "Korsvika" not in got
    assert got["Korsvika Beach"] == "Landmark"


def test_knowledge(spark):
    empty = spark.createDataFrame([], "project_id string, run_id string")
    got = {r.project_id: r for r in dashboards.knowledge_score(X.brands(spark), empty, empty, empty).collect()}
    assert got["boat"].score > 50 and "Brand documents" in got["boat"].missing


def test_brand_topics(spark):
    got = {(r.project_id, r.topic): r.fact for r in brand_topics(X.brands(spark)).collect()}
    assert got[("boat", "parking")] == "Free parking behind the smokehouse"


def brute_leaders(items, similar):
    leaders, out = [], {}
    for o, f in sorted(items):
        hit = next((lo for lo, lf in leaders if similar(lf, f)), None)
        if hit is None:
            leaders.append((o, f))
        out[o] = o if hit is None else hit
    return out


def py_jaccard(a, b):
    a, b = set(a), set(b)
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.5


def py_same(a, b):
    if not a or not b:
        return False
    s, long = sorted((a, b), key=len)
    return a == b or (len(s) >= 5 and (long + " ").startswith(s + " "))


WAYS = [(1000, 10_000), (1, 10_000), (1000, 1), (1, 1)]  # edges settled in one task; items from which buckets lead


def test_set_leaders_equal_brute_force(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    sets = {"a": [], "b": []}
    for k in sets:
        seen = set()
        for o in range(70):
            f = tuple(sorted(rnd.sample(words, rnd.randint(1, 5)), key=lambda w: (-len(w), w)))
            if f not in seen:
                seen.add(f)
                sets[k].append((o, list(f)))
    df = spark.createDataFrame([(k, o, f) for k, v in sets.items() for o, f in v], "k string, ord long, words array<string>")
    for local_edges, collapse_from in WAYS:
        got = questions.leading_sets(df, ["k"], 0.5, local_edges, collapse_from).collect()
        for k, v in sets.items():
            assert {r.ord: r.leader_ord for r in got if r.k == k} == brute_leaders(v, py_jaccard), (k, local_edges, collapse_from)


def test_name_leaders_equal_brute_force(spark):
    rnd = random.Random(5)
    toks = ["old", "mill", "garden", "by", "the", "river"]
    names = sorted({" ".join(rnd.choices(toks, k=rnd.randint(1, 4))) for _ in range(60)}, key=lambda s: rnd.random())
    items = list(enumerate(names))
    df = spark.createDataFrame([("r", o, f) for o, f in items], "k string, ord long, feature string")
    for local_edges in (1000, 1):
        got = leader_clusters(df, ["k"], lambda a, b: visibility.name_pairs(a, b, ["k"]), local_edges=local_edges).collect()
        assert {r.ord: r.leader_ord for r in got} == brute_leaders(items, py_same)


def test_one_word_in_many_dissimilar_sets(spark):
    """One word is shared by 20,000 sets that resemble none other: all lead, and no pair is sent on."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("ord"), F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("words"))
    got = questions.leading_sets(df, ["k"], 0.5)
    assert got.filter("leader_ord = ord").count() == 20_000
    shaped = setjoin.prepared(df, ["k"], 0.5)
    assert setjoin.candidates(shaped, shaped, ["k"], 0.5, True).count() == 0


def test_many_alike_sets_and_a_long_chain(spark):
    alike = [("a", i, [f"w{j}" for j in range(20)] + [f"x{i}"]) for i in range(3_000)]
    chain = [("c", i, [f"c{i + j:05d}" for j in range(3)]) for i in range(3_000)]  # each resembles the next alone
    df = spark.createDataFrame(alike + chain, "k string, ord long, words array<string>").repartition(4)
    got = questions.leading_sets(df, ["k"], 0.5, collapse_from=1_000)
    groups = {(r.k, r.leader_ord): r["count"] for r in got.groupBy("k", "leader_ord").count().collect()}
    assert groups == {("a", 0): 3_000, **{("c", i): 2 for i in range(0, 3_000, 2)}}


def test_cells_of_hot_words_lose_no_pair(spark):
    rnd = random.Random(4)
    rows = [(i, ["every", "some"] + [f"w{rnd.randint(0, 5)}" for _ in range(2)]) for i in range(120)]
    rows = [(i, list(dict.fromkeys(w))) for i, w in rows]
    shaped = setjoin.prepared(spark.createDataFrame(rows, "ord long, words array<string>"), [], 0.5)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and py_jaccard(x, y)}
    for cell in (7, 4_000):
        assert {(r.ord_a, r.ord_b) for r in setjoin.similar(shaped, shaped, [], 0.5, cell=cell).collect()} == want


def test_similar_clusters(spark):
    rnd = random.Random(6)
    words = [f"w{i:02d}" for i in range(14)]
    rows = [(i, sorted(rnd.sample(words, rnd.randint(0, 5)))) for i in range(80)] + [(200, None), (201, ["w01", "w02"]), (202, ["w01", "w02"])]
    df = spark.createDataFrame(rows, "id int, ws array<string>")
    got = {r.member: (r.leader, round(r.similarity, 9), r["size"]) for r in questions.similar_clusters(df, "id", "ws", 0.5).collect()}
    first = {}
    for i, w in rows:
        if w:
            first.setdefault(tuple(w), i)
    leader = brute_leaders([(i, list(w)) for w, i in first.items()], py_jaccard)
    of = {i: leader[first[tuple(w)]] for i, w in rows if w}
    sets = dict(rows)
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {i: (l, round(j(sets[i], sets[l]), 9), sum(x == l for x in of.values())) for i, l in of.items()}
    assert questions.similar_clusters(df.limit(0), "id", "ws", 0.5).collect() == []


def test_similar_pairs(spark):
    rnd = random.Random(2)
    words = [f"w{i:03d}" for i in range(15)]
    rows = [(i, sorted(rnd.sample(words, rnd.randint(2, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ws array<string>")
    got = {(min(r.id_a, r.id_b), max(r.id_a, r.id_b)) for r in questions.similar_pairs(df, "id", "ws", 0.5).collect()}
    first = {}
    for i, w in rows:
        first.setdefault(tuple(w), i)
    reps = sorted((i, w) for w, i in first.items())
    want = {(a, b) for a, wa in reps for b, wb in reps if a < b and py_jaccard(wa, wb)}
    assert got == want


def test_vector_topk_equals_brute_force(spark):
    rnd = random.Random(1)
    hubs = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    vec = lambda: [x + rnd.gauss(0, 0.1) for x in rnd.choice(hubs)]
    chunks = [(rnd.choice("pq"), i, vec()) for i in range(300)]
    chunks += [("p", 300 + i, hubs[0]) for i in range(30)] + [("p", 400, None), ("p", 401, [0.0] * 8)]  # ties, no vector, no direction
    queries = [(p, f"{p}{i}", vec()) for p in "pq" for i in range(6)] + [("p", "hub", hubs[0]), ("p", "none", None), ("p", "zero", [0.0] * 8), ("r", "r0", vec())]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = set()
    for p, q, v in queries:
        if v and any(v):
            near = sorted((round(-cos(v, x), 12), c) for o, c, x in chunks if o == p and x and any(x))[:5]
            want |= {(p, q, c, k + 1) for k, (_, c) in enumerate(near)}
    c = spark.createDataFrame(chunks, "project_id string, chunk_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "project_id string, query_id string, embedding array<double>")
    for slice_bytes, pivots in ((1 << 20, 64), (200, 3)):
        got = retrieval.vector_topk(q, c, 5, slice_bytes, pivots).collect()
        assert {(r.project_id, r.query_id, r.chunk_id, r["rank"]) for r in got} == want
    assert retrieval.vector_topk(q.limit(0), c, 5).collect() == [] and retrieval.vector_topk(q, c.limit(0), 5).collect() == []


def test_groups_that_cannot_hold_a_neighbour_are_not_compared():
    hubs = np.eye(8)
    chunks = np.vstack([h + 0.01 for h in hubs for _ in range(50)])
    chunks /= np.sqrt((chunks**2).sum(axis=1, keepdims=True))
    nearest = retrieval._Nearest(np.array(["q"]), hubs[:1], hubs, 5)
    seen = []
    offer = nearest._offer
    nearest._offer = lambda i, rows, *rest: (seen.append(len(rows)), offer(i, rows, *rest))
    nearest.add(np.arange(400), chunks)
    assert seen == [50] and [c for _, c in nearest.found[0]] == [0, 1, 2, 3, 4]


def brute_text_topk(requests, chunks, k):
    weight = [0.0]
    for i in range(1, 257):
        weight.append(weight[-1] + 0.1 / (i * i))
    weight = [round(w / 1.64493406685 * 10**12) for w in weight]
    out = set()
    for project, request, terms in requests:
        for p in {c[0] for c in chunks} if project is None else {project}:
            scores = []
            for owner, cid, text in chunks:
                n = Counter(text.split()) if owner == p else {}
                score = sum(weight[min(n[t], 256)] for t in terms if n and n[t])
                if score:
                    scores.append((-score, cid))
            out |= {(p, request, c, r + 1) for r, (_, c) in enumerate(sorted(scores)[:k])}
    return out


def test_text_topk_equals_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    heavy = [1 / (i + 1) for i in range(40)]  # some words are everywhere
    chunks = [(rnd.choice("pq"), i, " ".join(rnd.choices(words, heavy, k=rnd.randint(1, 30)))) for i in range(250)]
    chunks += [("p", 250, " ".join(words)), ("p", 251, "w0 " * 400)]
    requests = [(p, f"{p}{i}", rnd.sample(words, rnd.randint(1, 12))) for p in "pq" for i in range(8)] + [("p", "rare", ["nowhere"]), ("p", "all", words)]
    c = spark.createDataFrame(chunks, "project_id string, chunk_id long, content string").repartition(3)
    q = spark.createDataFrame(requests, "project_id string, request_id string, terms array<string>")
    rank = lambda df: {(r.project_id, r.request_id, r.chunk_id, r["rank"]) for r in df.collect()}
    for k in (1, 4):
        want = brute_text_topk(requests, chunks, k)
        assert rank(retrieval.text_topk(q, c, k)) == want
        assert rank(retrieval.text_topk(q, None, k, retrieval.token_index(c))) == want
        assert rank(retrieval.text_topk(q.drop("project_id"), c, k)) == brute_text_topk([(None, r, t) for _, r, t in requests], chunks, k)


def test_passages_of_hits(spark):
    hits = spark.createDataFrame([("p", "r", 2, 1), ("p", "s", 2, 1), ("p", "s", 1, 2)], "project_id string, request_id string, chunk_id long, rank int")
    chunks = spark.createDataFrame([("p", 1, 10, "one"), ("p", 2, 11, "two"), ("q", 2, 10, "other"), ("p", 3, 10, "three")], "project_id string, chunk_id long, document_id long, content string")
    documents = spark.createDataFrame([("p", 10, "Ten", "menu"), ("q", 10, "Other", None)], "project_id string, document_id long, title string, category string")
    got = {(r.request_id, r.chunk_id, r.content, r.title, r.category) for r in retrieval.with_passages(hits, chunks, documents).collect()}
    assert got == {("r", 2, "two", None, None), ("s", 2, "two", None, None), ("s", 1, "one", "Ten", "menu")}


def test_retrieve_text_fallback(spark):
    chunks = spark.createDataFrame(
        [("p", 1, "The pool is open and the pool is warm", None), ("p", 2, "Breakfast by the pool", None), ("p", 3, "Nothing here", None)],
        "project_id string, chunk_id long, content string, embedding array<float>",
    )
    req = spark.createDataFrame([("p", "r", [("pool breakfast", None)])], "project_id string, request_id string, queries array<struct<text:string,embedding:array<float>>>")
    got = [r.chunk_id for r in retrieval.retrieve(req, chunks).orderBy("rank").collect()]
    assert got == [2, 1]


def test_passages_in_every_language(spark, tmp_path):
    from brandloom.workload import draft_queries

    docs = [(1, "the blue boat sails home", "en"), (2, "la barca blue torna", "it"), (3, "blue without language", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "blue")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = draft_queries.passage_search(spark, str(tmp_path)).collect()
    assert {(x.project_id, x.request_id, x.chunk_id, x["rank"]) for x in got} == {("en", 7, 10_000, 1), ("it", 7, 20_000, 1), (None, 7, 30_000, 1)}


def test_phrase_table(spark):
    """Phrases of any length by joins, against a search in the plain texts."""
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "Ä b, A-B"), (62, "b b b"), (63, "a b " * 400)]
    phrases = [(t, " ".join(rnd.choice("aAb") for _ in range(n))) for t, n in enumerate([0, 1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 20])] + [(90, "a b a b a b a b a b a"), (91, "zz a"), (92, None), (1, "b  b")]
    got = phrase_matches(
        spark.createDataFrame(texts, "k int, text string").withColumn("phrase", F.lit("clash")), ["k"], "text", spark.createDataFrame(phrases, "topic int, phrase string"), ["topic"],
    ).collect()
    plain = lambda x: " ".join(re.findall("[a-z0-9]+", (x or "").lower().replace("ä", "a")))
    want = {(k, t, plain(p)) for k, x in texts for t, p in phrases if plain(p) and f" {plain(p)} " in f" {plain(x)} "}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 100


def test_overview_counts_children_in_one_aggregation(spark):
    names = X.brands(spark).select("project_id")
    child = lambda n: names.crossJoin(spark.range(n)).select("project_id")
    drafts, runs = child(2).selectExpr("project_id", "80 AS overall"), child(1).selectExpr("project_id", "1 AS run_id", "'local_context' AS kind", "'done' AS status", "1 AS created_at", "0.5 AS brand_rate")
    o = dashboards.project_overview(X.brands(spark), child(3), drafts, child(4).selectExpr("project_id", "true AS apply_as_rule"), runs, child(5), child(0))
    assert {(r.n_documents, r.n_rules, r.n_briefs, r.n_gsc, r.n_drafts, r.n_runs) for r in o.collect()} == {(3, 4, 5, 0, 2, 1)}
    plan = o._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") <= 4  # not one for each child


def test_similar_pairs_gather_only_sets_within_reach(spark, monkeypatch):
    """Pairs of few items against many sets equal brute force, and sets that can't resemble any are not gathered."""
    rnd = random.Random(9)
    words = [f"w{i:03d}" for i in range(40)]
    items = [(i, sorted(rnd.sample(words[:20], rnd.randint(2, 6)))) for i in range(30)] + [(98, []), (99, None)]
    docs = [(i, sorted(rnd.sample(words, rnd.randint(1, 9)))) for i in range(300)] + [(400, []), (401, None), (402, ["w001", "w002"]), (403, ["w001", "w002"])]
    docs += [(1_000 + i, [f"far{i}", f"off{i}", "w001"]) for i in range(500)]
    seen = []
    monkeypatch.setattr(questions, "prepared", lambda sets, *a, f=questions.prepared: seen.append(sets.count()) or f(sets, *a))
    a, b = (spark.createDataFrame(x, "id int, ws array<string>") for x in (items, docs))
    sides = []
    for rows in (items, docs):
        by = {}
        for i, w in rows:
            if w:
                by.setdefault(tuple(w), []).append(i)
        sides.append({w: (min(v), len(v)) for w, v in by.items()})
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(x[0], y[0], x[1], y[1], round(j(w, v), 9)) for w, x in sides[0].items() for v, y in sides[1].items() if j(w, v) >= 0.4}
    got = questions.similar_pairs(a, "id", "ws", 0.4, against=b).collect()
    assert {(r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)
    assert seen[0] < len(sides[0]) + 250
    assert questions.similar_pairs(a.limit(0), "id", "ws", 0.4, against=b).collect() == []
