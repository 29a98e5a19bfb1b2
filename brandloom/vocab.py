"""Fixed values the results depend on: word lists, patterns, curves and labels.

Everything in this module is a fixed value (plain text, natural order).  No
logic lives here; the Column functions and operators read these names.  Patterns
use ASCII word boundaries and are matched through ``functions.regex`` helpers.
"""

from __future__ import annotations

# --- fixed values: whitespace --------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_CLASS = "[\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# --- fixed values: word lists --------------------------------------------------
STOPWORDS = (
    "a an and are as at be but by can do does for from has have how i if in into is it its my near "
    "not of on or our so than that the their them there these they this to up us was we what when "
    "where which who why will with you your best top"
).split()

QUERY_STOPWORDS = (
    "the a an and or of to in on for with at by from is are was were be this that it as our your we you they their its"
).split()

TITLE_SMALL_WORDS = "a and as at but by for in nor of on or per the to vs via with from".split()

NAME_STOP_NOUNS = "the hotel resort and spa villa villas boutique restaurant".split()

# --- fixed values: topic lexicon (id, label, format, patterns) -------------------
TOPICS = [
    ("location", "Location", None, [r"\blocation\b", r"\bcentral\b", r"\bwalk(ing)? (distance|to)\b", r"\b\d+ ?(min|mins|minutes?) (walk|drive|from)\b", r"\bclose to\b", r"\bheart of\b", r"\bdowntown\b", r"\bcbd\b"]),
    ("breakfast", "Breakfast", None, [r"\bbreakfast\b", r"\bbrunch\b"]),
    ("dining", "Dining", None, [r"\brestaurants?\b", r"\bdining\b", r"\bcuisine\b", r"\bfood\b", r"\bbar\b", r"\bcafe\b", r"\bmenu\b", r"\bdinner\b"]),
    ("rooms", "Rooms", None, [r"\brooms?\b", r"\bsuites?\b", r"\bbeds?\b", r"\bbalcon(y|ies)\b", r"\bvillas?\b", r"\bapartments?\b"]),
    ("room_comparison", "Room comparison", "Room comparison page", [r"\broom types?\b", r"\bwhich room\b", r"\b(compare|comparison|vs\.?|versus)\b.*\broom", r"\broom.*\b(compare|comparison|vs\.?|versus)\b", r"\bsuite vs\b"]),
    ("pool", "Pool", None, [r"\bpools?\b", r"\bswimming\b", r"\binfinity\b"]),
    ("spa", "Spa & wellness", None, [r"\bspa\b", r"\bmassage\b", r"\bwellness\b", r"\bsauna\b"]),
    ("family", "Family travel", "Family guide", [r"\bfamil(y|ies)\b", r"\bkids?\b", r"\bchildren\b", r"\bchild\b", r"\btoddlers?\b", r"\bbab(y|ies)\b"]),
    ("couples", "Couples & romance", None, [r"\bcouples?\b", r"\bromantic\b", r"\bhoneymoon\b", r"\banniversary\b"]),
    ("business", "Business travel", None, [r"\bbusiness\b", r"\bmeetings?\b", r"\bconference\b", r"\bcoworking\b", r"\bwork trip\b"]),
    ("parking", "Parking", None, [r"\bparking\b", r"\bcar ?park\b", r"\bvalet\b"]),
    ("transport", "Transport information", "Getting here guide", [r"\bairport\b", r"\btransfers?\b", r"\bshuttle\b", r"\btaxi\b", r"\bgrab\b", r"\btrain\b", r"\bmrt\b", r"\bbus\b", r"\btram\b", r"\bgetting (there|around)\b", r"\bhow to get\b", r"\btransport\b"]),
    ("itinerary", "Local itinerary", "Local guide / itinerary", [r"\bitinerar(y|ies)\b", r"\bthings to do\b", r"\battractions?\b", r"\bsightseeing\b", r"\bday trips?\b", r"\bwhat to do\b", r"\b\d+ (days?|nights?) in\b", r"\bnearby\b"]),
    ("price", "Price & value", None, [r"\bprices?\b", r"\bcheap\b", r"\bbudget\b", r"\bvalue\b", r"\baffordable\b", r"\bexpensive\b", r"\bcosts?\b", r"\bdeals?\b", r"\brates?\b", r"\boverpriced\b"]),
    ("view", "Views", None, [r"\bviews?\b", r"\brooftop\b", r"\bocean\b", r"\bsea ?view\b", r"\bskyline\b", r"\bpanoramic\b"]),
    ("beach", "Beach", None, [r"\bbeach(es|front)?\b", r"\bseaside\b"]),
    ("service", "Service", None, [r"\bstaff\b", r"\bservice\b", r"\bfriendly\b", r"\bhelpful\b", r"\breception\b", r"\bhospitality\b", r"\bconcierge\b"]),
    ("cleanliness", "Cleanliness", None, [r"\bclean(liness)?\b", r"\bdirty\b", r"\bspotless\b", r"\bhygien", r"\bdust"]),
    ("noise", "Noise", None, [r"\bnois(e|y)\b", r"\bquiet\b", r"\bloud\b", r"\bpeaceful\b"]),
    ("size", "Room size", None, [r"\bsmall\b", r"\bspacious\b", r"\btiny\b", r"\bcramped\b", r"\bsqm\b", r"\bm2\b", r"\bsquare met"]),
    ("events", "Weddings & events", None, [r"\bweddings?\b", r"\bevents?\b", r"\bfunctions?\b", r"\bballroom\b"]),
    ("fitness", "Gym & fitness", None, [r"\bgym\b", r"\bfitness\b", r"\byoga\b"]),
    ("wifi", "Wi-Fi", None, [r"\bwi-?fi\b", r"\binternet\b"]),
    ("pets", "Pet-friendly", None, [r"\bpets?\b", r"\bdogs?\b", r"\bpet friendly\b"]),
    ("accessibility", "Accessibility", None, [r"\baccessib", r"\bwheelchair\b", r"\blifts?\b", r"\belevators?\b", r"\bstairs\b"]),
    ("shopping", "Shopping & nightlife", None, [r"\bshopping\b", r"\bmarkets?\b", r"\bnightlife\b", r"\bnight market\b", r"\bmall\b"]),
    ("checkin", "Check-in & policies", None, [r"\bcheck[- ]?in\b", r"\bcheck[- ]?out\b", r"\bpolic(y|ies)\b", r"\bcancell?ation\b"]),
    ("safety", "Safety", None, [r"\bsafe(ty)?\b", r"\bsecurity\b"]),
]
GENERIC_TOPICS = ["location", "rooms", "service", "price"]
AUDIENCE_TOPICS = ["family", "couples", "business"]
AUDIENCE_LABELS = {"family": "Families", "couples": "Couples", "business": "Business travellers"}
STAPLE_TOPICS = ["family", "itinerary", "transport", "room_comparison"]
DEFAULT_GAP_FORMAT = "New section"

# --- fixed values: search intent -------------------------------------------------
INTENT_PATTERNS = [
    ("Transactional", r"\b(book|booking|deals?|discount|promo|coupon|reserve|reservation|rates?|price|prices|cheap|cheapest|packages?|offer)\b"),
    ("Commercial investigation", r"\b(best|top|vs|versus|reviews?|compare|comparison|alternatives?|recommended|which|luxury|boutique|rated)\b"),
    ("Local", r"\b(near|nearby|near me|close to|around|walking distance|in the area)\b"),
    ("Informational", r"\b(how|what|why|when|where|is|are|can|does|do|guide|things to do|tips|ideas|itinerary|history|weather|meaning)\b|\?$"),
]
INTENT_FALLBACK_PATTERN = r"\b(hotels?|resorts?|restaurants?|villas?|stays?)\b"
INTENT_BOOKING_PATTERN = r"\b(book|deal|promo|coupon|reserve)\b"

# --- fixed values: questions -----------------------------------------------------
QUESTION_LIKE = r"^(how|what|where|when|which|who|why|is|are|can|do|does|should|would|will|any|anyone|looking for|recommend)\b|\?\s*$"
FORUM_TITLE_SUFFIXES = [r"\s*[:|-]\s*r/\w+.*$", r"\s*[-|]\s*(reddit|tripadvisor|quora).*$"]
QUESTION_HEADING = r"\?$|^(how|what|where|when|which|why|is|are|can|do)\b"
QUESTION_SOURCE_WEIGHTS = {"People Also Ask": 2}

# --- fixed values: entities ------------------------------------------------------
ENTITY_GENERIC = (
    "best top the a our your you we it this that these those what how where why when is are can do does which who "
    "hotel hotels resort resorts things guide review reviews updated prices price deals book booking tripadvisor google "
    "maps reddit expedia agoda booking.com trip.com hotels.com airbnb kayak travel stay stays visit visiting day days "
    "night nights week weekend new free official home page read more view see here also "
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday "
    "i if in on at of for from with and or but to by near places ultimate complete list tips people also ask room rooms "
    "suite suites family families couples luxury boutique cheap budget"
).split()
ENTITY_EDGE = (
    "best top the a our your you we it this that what what's whats how where why when is are can do does which who find "
    "latest new updated read more view see here also book booking deals prices price guide review reviews near things"
).split()
ENTITY_BUSINESS = r"\b(hotel|hotels|resort|inn|suites|apartments|motel|hostel|lodge|restaurant|bar|cafe|spa|villas?)\b"
ENTITY_LANDMARK = (
    r"\b(market|oval|square|beach|bridge|temple|museum|park|street|road|airport|station|mall|island|river|bay|hill|hills"
    r"|garden|gardens|pagoda|cathedral|church|palace|lake|mountain|falls|tower|gallery|zoo|stadium|harbour|harbor|pier"
    r"|old town|quarter|village|night market|precinct|lane|mount|reserve|centre|center|wharf|terrace)\b"
)
CAPITALISED_RUN = r"\b([A-Z][\p{L}'’.-]+(?:\s+(?:of|the|de|du|la|le|by)\s+[A-Z][\p{L}'’.-]+|\s+[A-Z][\p{L}'’.-]+){0,4})"

# --- fixed values: review sentiment ----------------------------------------------
NEGATIVE_WORDS = (
    r"\b(not|n't|no|never|but|however|although|small|tiny|cramped|noisy|loud|dirty|smell|smelly|expensive|overpriced"
    r"|pricey|rude|slow|far|old|dated|broken|disappoint\w*|poor|bad|worst|issues?|problems?|lack(ing)?|limited|mediocre"
    r"|average|uncomfortable|hard|difficult|crowded|busy|wait(ed|ing)?)\b"
)
POSITIVE_WORDS = (
    r"\b(great|excellent|amazing|lovely|friendly|clean|perfect|delicious|beautiful|spacious|helpful|comfortable|best|good"
    r"|nice|wonderful|fantastic|superb|awesome|loved?|convenient|quiet|stunning|attentive|recommend(ed)?|brilliant"
    r"|gorgeous|fresh|central)\b"
)

# --- fixed values: result formats and domains --------------------------------------
OTA_DOMAINS = r"(booking|agoda|expedia|hotels\.com|trip\.com|airbnb|traveloka|vrbo|kayak|trivago)"
CITATION_OTA_DOMAINS = r"(booking|agoda|expedia|hotels\.com|trip\.com|airbnb|traveloka|vrbo|kayak)"
CITATION_REVIEW_DOMAINS = r"(tripadvisor|google|yelp|foursquare)"
CITATION_FORUM_DOMAINS = r"(reddit|quora|forum|lonelyplanet\.com/thorntree)"
FORUM_RESULT = r"reddit|quora|forum|tripadvisor\.[a-z.]+/showtopic"
LISTICLE_TITLE = r"\b\d+\s+(best|top|things|places|ways|reasons|hotels|restaurants)\b|\btop \d+|\bbest\b.*\b\d+\b"
COMPARISON_TITLE = r"\bvs\.?\b|versus|compar"
GUIDE_TITLE = r"\bguide\b|\bitinerary\b|\bhow to\b"
REVIEW_TITLE = r"\breview"
ACCOMMODATION_QUERY = r"\b(hotels?|resorts?|stay|stays|accommodation|villas?|where to stay)\b"
ACCOMMODATION_PROFILE = r"hotel|resort|villa|hospitality"

# --- fixed values: content markup ---------------------------------------------------
MD_HEADING = r"^(#{1,6})\s+(.+)$"
HTML_HEADING = r"<h([1-6])[^>]*>(.*?)</h\1>"
MD_LINK = r"\[([^\]]+)\]\(([^)\s]+)\)"
HTML_LINK = r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
TAG = r"<[^>]+>"
MD_LINK_TEXT = r"\[([^\]]+)\]\([^)]+\)"
MD_HEADING_MARK = r"^#{1,6}\s+"
MD_SIGNS = r"[*_`>]"

# --- fixed values: search console --------------------------------------------------
GSC_QUESTION = r"^(how|what|where|when|which|who|why|is|are|can|do|does|should|best|top)\b|\?$"
GSC_COMPARISON = r"\b(vs|versus|or|alternative|alternatives|compare|comparison|like|similar)\b"
GSC_LOCAL = r"\b(near|nearby|near me|close to|walking distance|around|from|to)\b"
CTR_CURVE = [0.28, 0.16, 0.11, 0.08, 0.06, 0.045, 0.035, 0.03, 0.025, 0.02]
CTR_SECOND_PAGE = 0.01
CTR_BEYOND = 0.003
MAP_ZOOM = ",14z"
GSC_HEADERS = {
    "query": ["top queries", "query", "queries"],
    "page": ["page", "url", "landing"],
    "clicks": ["clicks"],
    "impressions": ["impressions"],
    "ctr": ["ctr"],
    "position": ["position"],
}

# --- fixed values: content checks --------------------------------------------------
SPELLING_PAIRS = [
    ("color", "colour"), ("center", "centre"), ("favorite", "favourite"), ("traveling", "travelling"), ("traveler", "traveller"),
    ("organize", "organise"), ("realize", "realise"), ("theater", "theatre"), ("neighborhood", "neighbourhood"), ("program", "programme"),
    ("jewelry", "jewellery"), ("catalog", "catalogue"), ("gray", "grey"), ("apologize", "apologise"), ("personalized", "personalised"),
    ("flavor", "flavour"), ("honor", "honour"), ("harbor", "harbour"), ("cozy", "cosy"), ("specialty", "speciality"), ("modernized", "modernised"),
]
UK_VARIANTS = r"british|uk|australian|au|nz"
DEFAULT_ENGLISH = "British English"
DISTANCE = r"\b\d+(\.\d+)?\s?(-|–)?\s?(min|mins|minutes?|km|kilometres?|kilometers?|m|metres?|meters?|miles?|hours?)\b"
FIGURE = (
    r"\b(\d[\d,.]*)\s?(rooms?|suites?|villas?|keys|minutes?|mins?|km|metres?|meters?|m2|sqm|restaurants?|bars?|pools?"
    r"|floors?|storeys?|stars?|%|percent|years?)\b"
)
FIRST_PERSON = r"\b(we|our|the hotel|the resort|the property)\b"
CALL_TO_ACTION = (
    r"\b(book( now| your stay| direct)?|reserve|check availability|plan your (stay|trip)|enquire|inquire|contact us"
    r"|get in touch|call us|request a quote|view rooms|see offers|discover more)\b"
)
BOOKING_LINK = r"book|reserv|availability|offers?|rooms?"
CLAIM_PREFIXES = [
    r"^(cannot|can't|can not|must not|never|do not|don't|no|not allowed to)\s+(claim|say|mention|call (us|it)|use|state|promote)\s*(that|a|an|the)?\s*",
    r"^(no|not)\s+",
]
NEGATIVE_RULE = r"\b(never|avoid|don't|do not|stop|not)\b"
QUOTED_PHRASE = "[\"“']([^\"”']{3,40})[\"”']"
NEVER_CALL = r"\bnever (?:call|describe|refer to) (?:us|it|the (?:hotel|property)) (?:as )?(?:a |an )?([a-z-]+)"
AREA_WEIGHTS = [("seo", 0.3), ("geo", 0.25), ("brand", 0.3), ("conversion", 0.15)]

# --- fixed values: pipeline and knowledge ------------------------------------------
PIPELINE = [
    ("planned", "Planned"), ("processing", "In Progress"), ("draft", "Draft"),
    ("review", "Review"), ("complete", "Complete"), ("published", "Published"),
]
IN_FLIGHT = ["planned", "processing", "draft", "review"]
RULE_KINDS = ["rule", "fact_correction"]
