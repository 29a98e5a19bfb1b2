import random

import pytest
from pyspark.sql import functions as F

from brandloom.functions import names as N
from brandloom.functions import search as S
from brandloom.functions import text as T
from brandloom.functions.lexicon import HOSPITALITY


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0].v


CASES = [
    (lambda: T.fold(F.lit("Khách sạn Đà Nẵng É")), "khach san da nang e"),
    (lambda: N.normalize_name(F.lit("Khách sạn Đà Nẵng")), "khach san da nang"),
    (lambda: T.title_case(F.lit("where to stay in hoi an for couples")), "Where to Stay in Hoi An for Couples"),
    (lambda: T.clean_text(F.lit("# Title\n\n\n\nBody \n")), "# Title\n\nBody"),
    (lambda: S.claim_phrase(F.lit("Cannot claim Michelin-starred")), "Michelin-starred"),
    (lambda: S.banned_from_rules(F.array(F.lit("Never call us a resort."), F.lit('Avoid "hidden gem"'), F.lit("Say resort"))), ["resort", "hidden gem"]),
    (lambda: S.classify_intent(F.lit("best things to do in Adelaide"), F.array(F.lit("")))["label"], "Commercial + Informational"),
    (lambda: S.classify_intent(F.lit("best hotels in Adelaide CBD"), F.array(F.lit("")))["primary"], "Commercial investigation"),
    (lambda: S.classify_intent(F.lit("book hotel indigo adelaide"), F.array(F.lit("hotel indigo adelaide")))["all"], ["Navigational", "Transactional"]),
    (lambda: S.classify_intent(F.lit("hotels near adelaide oval"), F.array(F.lit("")))["all"], ["Local"]),
    (lambda: T.domain_of(F.lit("https://www.Example.com:80/a?b")), "example.com"),
    (lambda: T.domain_of(F.lit("www.example.com/a")), "example.com"),
    (lambda: T.citation_domain(F.lit("example.com/a")), "example.com/a"),
    (lambda: T.lines(F.lit("- one fact; x two\n❌ Cannot claim z\n•")), ["one fact", "two", "Cannot claim z"]),
    (lambda: T.sentences(F.lit("Hi there. You!\nNew line")), ["Hi there.", "You!", "New line"]),
    (lambda: T.contains_phrase(F.lit("A Café, here"), F.lit(" cafe ")), True),
    (lambda: T.contains_phrase(F.lit("A cafeteria"), F.lit("cafe")), False),
    (lambda: T.contains_phrase(F.lit("costs $5 (net)"), F.lit("$5 (net)")), True),
    (lambda: T.contains_phrase(F.lit("x"), F.lit("  ")), False),
    (lambda: T.decode_entities(F.lit("&amp;lt; &lt;b&gt;")), "&lt; <b>"),
    (lambda: HOSPITALITY.topics_in(F.lit("Rooms, breakfast near the airport")), ["breakfast", "rooms", "transport"]),
    (lambda: HOSPITALITY.primary_topic(F.lit("room prices and pool")), "pool"),
    (lambda: HOSPITALITY.primary_topic(F.lit("room prices")), "rooms"),
    (lambda: S.localize(F.lit("hotels"), F.lit("Hoi An")), "hotels Hoi An"),
    (lambda: T.first_content_words(F.lit("the " * 150 + "copper kettle tea"), 2), ["copper", "kettle"]),
    (lambda: T.first_content_words(F.lit("copper kettle tearoom"), 2, head=10), ["copper", "kettle"]),
    (lambda: S.headings(F.lit("# One\n<H2 class=x>Two <b>b</b></H2>\n## Three ")), [(1, "One"), (2, "Three"), (2, "Two b")]),
    (lambda: S.links(F.lit('[a](/b) <a href="/c">d <i>e</i></a>')), [("a", "/b"), ("d e", "/c")]),
    (lambda: S.number_text(F.lit(-0.78) / 100), "-0.0078000000000000005"),
    (lambda: S.number_text(F.lit(0.07) / 100), "0.0007000000000000001"),
    (lambda: S.number_text(F.lit(-0.0)), "-0"),
    (lambda: S.map_view(F.lit(100.0), F.lit(-7.5e-05)), "@100,-0.000075,14z"),
    (lambda: S.localize(F.lit("hotels in hoi an"), F.lit("Hoi An")), "hotels in hoi an"),
    (lambda: S.place_string(F.lit("Hoi An"), F.lit(None).cast("string"), F.lit("Vietnam")), "Hoi An, Vietnam"),
    (lambda: S.clean_forum_title(F.lit("Best area? : r/lisbon stuff")), "Best area?"),
    (lambda: S.sentiment(F.lit("The room was small and noisy."), F.lit(5.0)), -1),
    (lambda: S.sentiment(F.lit("A room."), F.lit(4.0)), 1),
    (lambda: S.sentiment(F.lit("A room."), F.lit(None).cast("double")), 0),
    (lambda: S.skipped_level(S.headings(F.lit("# a\n### b"))), True),
    (lambda: S.skipped_level(S.headings(F.lit("no heading"))), False),
    (lambda: S.headings(F.lit("<h2 class='x'>Q <b>r</b></h2>\n# T")), [(1, "T"), (2, "Q r")]),
    (lambda: S.links(F.lit("[a](/x) <a class=y href='/z'>b<i>c</i></a>")), [("a", "/x"), ("bc", "/z")]),
    (lambda: S.expected_ctr(F.lit(0.2)), 0.28),
    (lambda: S.expected_ctr(F.lit(9.6)), 0.02),
    (lambda: S.expected_ctr(F.lit(15.0)), 0.01),
    (lambda: T.words(F.lit("don't stop: Naïve 2x")), ["don't", "stop", "naive", "2x"]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_text_case(spark, i):
    make, expected = CASES[i]
    assert one(spark, make()) == expected


def _norm(s):
    return s


def test_same_business_pairs(spark):
    pairs = [
        ("Anio Boutique Hotel Hoi An", "Anio Boutique Hotel Hoi An", True),
        ("Hoi An", "Little Hoi An Boutique Hotel", False),
        ("Allegro Hoi An . Little Luxury Hotel & Spa", "Allegro Hoi An", True),
        ("The Hotel", "Hotel", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    got = df.select("ok", N.same_norm(N.normalize_name(F.col("a")), N.normalize_name(F.col("b"))).alias("v")).collect()
    assert [r.v for r in got] == [r.ok for r in got]


def plain_chunks(text, size, overlap):
    """Straightforward packing, as a check on the Column fold."""
    out, cur = [], ""
    for p in [p.strip() for p in __import__("re").split(r"\n{2,}", text) if p.strip()]:
        if len(p) > size:
            out += [cur] if cur else []
            cur = ""
            out += [p[i:i + size] for i in range(0, len(p), size - overlap)]
        elif cur and len(cur) + 2 + len(p) > size:
            out.append(cur)
            cur = cur[-overlap:] + "\n\n" + p
        else:
            cur = cur + "\n\n" + p if cur else p
    return out + ([cur] if cur else [])


def test_chunks_equal_plain_loop(spark):
    rnd = random.Random(7)
    texts = ["\n\n".join("w" * rnd.randint(1, 70) + str(k) for k in range(rnd.randint(0, 9))) for _ in range(60)] + ["", "a\n\n\n\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in df.select("id", T.chunk_text(F.col("t"), 50, 7).alias("c")).collect():
        assert r.c == plain_chunks(texts[r.id], 50, 7)


def test_long_document_chunks(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(30))
    chunks = one(spark, T.chunk_text(F.lit(text)))
    assert len(chunks) > 3 and max(map(len, chunks)) <= 1400
