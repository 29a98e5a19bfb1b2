"""Invented inputs: a river boathouse with cabins, one result page about it, sampled answers and two drafts."""

from pyspark.sql import DataFrame, SparkSession

from brandloom.operators.brands import BRAND_SCHEMA
from brandloom.operators.visibility import CITATION, MENTION


def brands(spark: SparkSession) -> DataFrame:
    rows = [
        {
            "project_id": "boat", "brand_name": "Nidelva Boathouse Trondheim", "brand_aliases": ["Nidelva Boathouse"], "website": "https://nidelvaboathouse.example",
            "industry": "Hospitality", "property_type": "Guesthouse", "city": "Trondheim", "region": "Trøndelag", "country": "Norway", "country_code": "no",
            "brand_facts": "12 cabins above the water\nCanoe hire costs guests nothing\nSauna lit at 17 o'clock\nFree parking behind the smokehouse\n9-minute walk to Kristiansten Fortress",
            "usps": "Canoe hire costs guests nothing", "products": "Cabins, canoe hire, sauna evenings",
            "restricted_claims": "Cannot claim carbon-neutral\nCannot claim oldest inn", "words_to_avoid": "fairytale, bucket list",
            "words_to_use": "slow mornings, by the river", "target_customers": "Families with small children; rowing clubs",
            "cta_preference": "Reserve a cabin", "english_variant": "British English",
            "competitors": [("Lerkendal Lodge", None, None), ("Solsiden Pensjonat", None, None)],
            "site_pages": [("Our cabins", "https://nidelvaboathouse.example/cabins", None), ("Canoe trips", "https://nidelvaboathouse.example/canoes", None), ("Parking and the road in", "https://nidelvaboathouse.example/road", None)],
        },
        {
            "project_id": "tea", "brand_name": "Copper Kettle Tea Rooms", "brand_aliases": ["Copper Kettle"], "website": "https://copperkettle.example", "city": "Whitby",
            "industry": "Food", "competitors": [("Magpie Lane Bakery", None, None), ("Harbour Scones", None, None)],
        },
    ]
    names = BRAND_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], BRAND_SCHEMA)


ORGANIC = [
    ("Cabins and guesthouses: Trondheim", "https://www.booking.com/guesthouse/no/trondheim.html", "Lerkendal Lodge · Fjordgata Rooms"),
    ("Rowing weekend: which cabin to rent?", "https://www.reddit.com/r/norway/comments/77/rowing/", "Eight rowers, two cars, one dog. Is Fjordgata Rooms any good?"),
    ("A weekend by the Nidelva", "https://slowtravel.example/blog/nidelva-weekend", "We slept at Lerkendal Lodge and walked up to Kristiansten Fortress twice"),
    ("Solsiden Pensjonat", "https://solsidenpensjonat.example/", "Ten rooms by the dock. Kristiansten Fortress is up the hill"),
]
ASKS = ["Can you swim in the Nidelva in June?", "Is there a guesthouse with breakfast near the river in Trondheim?"]
RELATED = ["trondheim cabins with parking", "trondheim guesthouse near the river with breakfast"]


def serp(spark: SparkSession) -> dict:
    post = "serp_id string, ord int, title string, link string, snippet string, source string"
    return {
        "serps": spark.createDataFrame(
            [("p7", "boat", "top guesthouses in Trondheim", None, None, False)],
            "serp_id string, project_id string, query string, ai_overview string, answer_snippet string, has_answer boolean",
        ),
        "organic": spark.createDataFrame(
            [("p7", i, i, t, link, s) for i, (t, link, s) in enumerate(ORGANIC, 1)],
            "serp_id string, ord int, position int, title string, link string, snippet string",
        ),
        "questions": spark.createDataFrame([("p7", i, q, None) for i, q in enumerate(ASKS)], "serp_id string, ord int, question string, snippet string"),
        "related": spark.createDataFrame([("p7", i, q) for i, q in enumerate(RELATED)], "serp_id string, ord int, text string"),
        "forums": spark.createDataFrame([("p7", 0, "Does Trondheim suit toddlers in winter?", "https://board.example/t/4", "Two kids, one sledge", "Board")], post),
        "reddit": spark.createDataFrame([("p7", 0, "does trondheim suit toddlers in winter", "https://reddit.com/r/norway/9", None, "reddit.com")], post),
        "places": spark.createDataFrame(
            [
                ("p7", "local_pack", 1, 1, "Nidelva Boathouse", 4.9, 41), ("p7", "local_pack", 2, 2, "Lerkendal Lodge", 3.9, 220),
                ("p7", "maps", 1, 1, "Solsiden Pensjonat", 4.4, 75), ("p7", "maps", 2, 2, "Fjordgata Rooms", 4.0, 18),
            ],
            "serp_id string, list string, ord int, position int, title string, rating double, reviews int",
        ),
        "reviews": spark.createDataFrame(
            [
                ("p7", 0, "Google", "Lerkendal Lodge", 1.0, "Nowhere to put the car, parking was a nightmare."),
                ("p7", 1, "Google", "Lerkendal Lodge", 2.0, "Breakfast was cold and the bathroom dirty."),
                ("p7", 2, "Google", "Nidelva Boathouse Trondheim", 5.0, "Lovely breakfast in a basket."),
            ],
            "serp_id string, ord int, source string, place string, rating double, text string",
        ),
    }


# Faults: a restricted claim, a word to avoid, a misspelt brand, a rival, a figure that no fact has, American spelling,
# no call to action, no link, and neither of the required entities.
FAULTY = """# Trondheim guesthouses compared

If you only tick one thing off your bucket list, sleep above the water. Nidelva Bothouse Trondheim rents canoes. Nidelva Boathouse Trondheim has 30 rooms, and is carbon-neutral since last spring; the gray boards are original.

## Elsewhere

Lerkendal Lodge stands by the stadium."""

SOUND = """# Guesthouses in Trondheim: a night at Nidelva Boathouse Trondheim

At Nidelva Boathouse Trondheim you get one of 12 cabins above the water, and slow mornings with the window open over Trondheim. It is a 9-minute walk to Kristiansten Fortress from the door.

## Is it good for families?

Nidelva Boathouse Trondheim works for families with toddlers: railings are high, and free parking behind the smokehouse means a short carry. The Old Town Bridge is round the corner.

## What does a canoe cost?

Nothing. Canoe hire costs guests nothing, so paddle under the Old Town Bridge before lunch; the [canoe page](https://nidelvaboathouse.example/canoes) tells the hours and the [cabin page](https://nidelvaboathouse.example/cabins) shows every bed. Sauna lit at 17 o'clock.

Reserve a cabin today, or [book now](https://nidelvaboathouse.example/cabins) for June."""


def drafts(spark: SparkSession) -> DataFrame:
    required = ["Kristiansten Fortress", "Old Town Bridge"]
    return spark.createDataFrame(
        [("faulty", "boat", FAULTY, "guesthouses in Trondheim", required), ("sound", "boat", SOUND, "guesthouses in Trondheim", required)],
        "draft_id string, project_id string, content string, keyword string, required_entities array<string>",
    )


def _mentions(names):
    return [(n, n, i + 1, "neutral", "") for i, n in enumerate(names)]


def samples(spark: SparkSession) -> DataFrame:
    """Five answers to two prompts, one of them failed: the brand is named in three of the four, under two names."""
    kettle, short, bakery, scones = "Copper Kettle Tea Rooms", "Copper Kettle", "Magpie Lane Bakery", "Whitby Fudge Shop"
    rows = [
        ("w1", 0, 0, _mentions([bakery, kettle, short]), [("https://copperkettle.example/menu", "", "copperkettle.example")], None),
        ("w1", 0, 1, _mentions([bakery]), [], None),
        ("w1", 1, 0, _mentions([short, scones]), [("https://www.booking.com/whitby", "", "booking.com"), ("https://copperkettle.example/", "", "copperkettle.example")], None),
        ("w1", 1, 1, _mentions([kettle]), [], None),
        ("w1", 1, 2, None, None, "no answer in time"),
    ]
    return spark.createDataFrame(rows, f"run_id string, prompt_index int, iteration int, mentions array<{MENTION}>, citations array<{CITATION}>, error string")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("w1", "tea", [("cream tea in Whitby", "seed"), ("tea rooms with a view", "view")])], "run_id string, project_id string, prompts array<struct<prompt:string,angle:string>>")


def places(spark: SparkSession) -> DataFrame:
    rows = [
        ("w1", "maps", 1, 1, "Harbour Scones", 4.1, 310), ("w1", "maps", 2, 2, "Abbey Steps Cafe", 3.8, 12),
        ("w1", "maps", 3, 3, "Copper Kettle Tea Rooms", 4.6, 95), ("w1", "local_pack", 1, 1, "Copper Kettle Tea Rooms", 4.6, 95),
    ]
    return spark.createDataFrame(rows, "run_id string, list string, ord int, position int, title string, rating double, reviews int")
