"""Queries over literal rows whose right results are known beforehand: the bilingual text rules, opening hours, matching and the overlay.

Their SQL twins are the known results themselves, as ``VALUES``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placewright.functions import fuzzy, hours, text
from placewright.functions.geo import BBox
from placewright.operators import conflate, corpus, districts, index, overlay, quality, rank, search

QUERIES: dict = {}
SQL: dict = {}
NOW = "2026-09-05 12:00:00"
_PLACE = "id string, name_primary string, name_ar string, category string, lon double, lat double, phone string, website string, address_freeform string, confidence double, source_count int, opening_hours string"
#: A few places of two scripts around one mall.
PLACES = [
    ("p0", "Caribou Coffee", None, "coffee_shop", 46.6741, 24.7134, "+966112000001", None, "Olaya St", 0.98, 3, "Mo-Su 06:00-02:00"),
    ("p1", "Coffee Hill", None, "cafe", 46.6750, 24.7120, None, "https://hill.example.com", "Olaya St", 0.9, 2, "Sa-Th 08:00-23:00"),
    ("p2", "Kingdom Centre", "مركز المملكة", "shopping_center", 46.6744, 24.7114, None, "https://mall.example.com", "Olaya St", 0.97, 4, "24/7"),
    ("p3", "Zara Kingdom Centre", None, "clothing_store", 46.6746, 24.7116, None, None, "Kingdom Centre, Olaya St", 0.88, 2, None),
    ("p4", "صيدلية النهدي", "صيدلية النهدي", "pharmacy", 46.6760, 24.7100, "+966920003222", None, "Olaya St", 0.9, 3, "Mo-Su 08:00-24:00"),
    ("p5", "كرسبي كريم", None, "pharmacy", 46.6739, 24.7118, None, None, "Olaya St", 0.96, 2, None),
    ("p6", "Far Away Cafe", None, "cafe", 46.7400, 24.7800, "+966500000000", None, "Elsewhere", 0.7, 1, None),
]


def value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, datetime):
        return f"TIMESTAMP '{x}'"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def known(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({columns})"


def truth(columns: str, rows: list[tuple]):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        SQL[f.__name__] = known(columns, rows)
        return f

    return keep


def corpus_of(spark, more: list[tuple] = ()):
    return rank.recompute(corpus.conform(spark.createDataFrame([*PLACES, *more], _PLACE)))


def _numbered(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(v if isinstance(v, tuple) else (v,) for v in values)), f"i int, v struct<{kind if ':' in kind else 'x:' + kind}>").select("i", "v.*")


# text

_NAMES = {
    "مركز المملكة": "مركز المملكه", "مَرْكَزُ الْمَمْلَكَة": "مركز المملكه", "مـــركـــز المملكة": "مركز المملكه", "مركز المملكه": "مركز المملكه",
    "أحمد": "احمد", "احمد": "احمد", "إحمد": "احمد", "آحمد": "احمد", "كافيه ١٢٣": "كافيه 123", "۴۵۶": "456", "Al-Nakheel  Mall!": "al nakheel mall",
    "ﺱﻼﻡ": "سلام", "Hardee's": "hardees", "STRASSE ß": "strasse ss", "Ｃａｆé": "café", "مستشفى الوطن": "مستشفي الوطن", "مؤسسة": "موسسه", "ا، ب": "ا، ب", "": "",
}


@truth("i, norm", [*enumerate(_NAMES.values()), (len(_NAMES), "")])
def folded_names(spark):
    return _numbered(spark, [*_NAMES, None]).select("i", text.normalized(F.col("x")).alias("norm"))


_TOKENS = {"النخيل مول": "النخيل مول نخيل", "coffee COFFEE cafe": "قهوه", "كافيه": "قهوه", "الكافيه": "الكافيه كافيه", "قهوة قهوة": "قهوه", "pharmacy": "صيدليه", "صيدلية": "صيدليه", "الرياض": "الرياض رياض", "الله": "الله", "": ""}


@truth("i, tokens, plain", [(i, t, {"coffee COFFEE cafe": "coffee cafe", "كافيه": "كافيه", "قهوة قهوة": "قهوه", "pharmacy": "pharmacy", "النخيل مول": "النخيل مول", "الكافيه": "الكافيه", "الرياض": "الرياض"}.get(n, t)) for i, (n, t) in enumerate(_TOKENS.items())])
def bilingual_tokens(spark):
    join = lambda c: F.array_join(c, " ")
    return _numbered(spark, list(_TOKENS)).select("i", join(text.tokens(F.col("x"))).alias("tokens"), join(text.tokens(F.col("x"), expand=False)).alias("plain"))


@truth("blob", [("شنب قهوه hookah_bar olaya st",)])
def search_blobs(spark):
    return spark.range(1).select(text.search_blob(F.lit("شنب كافيه"), F.lit("hookah_bar"), F.lit(None).cast("string"), F.lit("Olaya St")).alias("blob"))


_SCRIPTS = [("مركز", True), ("Mall", False), ("Mall مول", True), ("", False), (None, False)]


@truth("i, arabic, roman", [(0, True, True), (1, False, False), (2, True, True), (3, False, False), (4, False, False)])
def scripts(spark):
    """Text with Arabic has a Latin form, other text has none."""
    return _numbered(spark, [x for x, _ in _SCRIPTS]).select("i", text.has_arabic(F.col("x")).alias("arabic"), (text.romanized(F.col("x")) != "").alias("roman"))


@truth("i, bridged", [(0, True), (1, True), (2, True), (3, False), (4, False)])
def romanized_names(spark):
    """Whether some form of an Arabic name is as good as equal to some form of a Latin one."""
    pairs = [("كوفي هيل", "Coffee Hill"), ("فندق النخيل", "Al Nakheel Hotel"), ("صيدلية النهدي", "Al Nahdi Pharmacy"), ("كوفي هيل", "Al Faisaliah Tower"), (None, "Coffee Hill")]
    return _numbered(spark, pairs, "a:string,b:string").select("i", (fuzzy.best_set_ratio(text.match_variants(F.col("a")), text.match_variants(F.col("b"))) >= 80).alias("bridged"))


_RATIOS = [("abcd", "abxd", 75.0), ("abc", "abc", 100.0), ("abc", "xyz", 0.0), ("a b", "b a c", 100.0), ("coffee hill", "hill coffee shop", 100.0), ("red mall", "blue mall", 70.5882), ("", "a", 0.0)]


@truth("i, token_set", [(i, r) for i, (_, _, r) in enumerate(_RATIOS)])
def fuzzy_ratios(spark):
    words = lambda c: F.filter(F.array(c), lambda x: x != "")
    return _numbered(spark, [r[:2] for r in _RATIOS], "a:string,b:string").select("i", F.round(fuzzy.best_set_ratio(words(F.col("a")), words(F.col("b"))), 4).alias("token_set"))


@truth("i, url, link", [(0, "https://commons.wikimedia.org/wiki/Special:FilePath/A_b/c.jpg", "https://www.google.com/maps/search/?api=1&query=24.5,46.25")])
def addresses(spark):
    return spark.range(1).select(F.lit(0).alias("i"), text.commons_url(F.lit("A b/c.jpg")).alias("url"), text.maps_url(F.lit(24.5), F.lit(46.25)).alias("link"))


# opening hours; 2026-09-04 is a Friday

_HOURS = [
    ("24/7", "2026-09-04 03:00", True, None), ("Sa-Th 08:00-23:00", "2026-09-04 10:00", False, "2026-09-05 08:00"), ("Sa-Th 08:00-23:00", "2026-09-05 10:00", True, "2026-09-05 23:00"), ("Su-Th 09:00-16:00", "2026-09-04 10:00", False, "2026-09-06 09:00"),
    ("Mo-Su 18:00-02:00", "2026-09-04 01:00", True, "2026-09-04 02:00"), ("Mo-Su 18:00-02:00", "2026-09-04 15:00", False, "2026-09-04 18:00"), ("Mo-Su 18:00-02:00", "2026-09-04 23:30", True, "2026-09-05 02:00"),
    ("Mo-Fr 09:00-12:00,16:00-21:00", "2026-09-04 13:00", False, "2026-09-04 16:00"), ("Mo-Fr 09:00-12:00,16:00-21:00", "2026-09-04 17:00", True, "2026-09-04 21:00"), ("Mo-Fr 09:00-17:00; Sa off", "2026-09-05 10:00", False, "2026-09-07 09:00"),
    ("Mo-Th,Su 8:00-17:00", "2026-09-06 09:00", True, "2026-09-06 17:00"), ("Mo-Su 09:00-17:00", "2026-09-04 09:00", True, "2026-09-04 17:00"), ("Mo-Su 09:00-17:00", "2026-09-04 17:00", False, "2026-09-05 09:00"), ("mo-su 09:00-17:00; PH off", "2026-09-04 12:00", True, "2026-09-04 17:00"),
    ("sunset-22:00", "2026-09-04 10:00", None, None), ("12pm-1am", "2026-09-04 10:00", None, None), ("Mar-Oct 09:00-18:00", "2026-09-04 10:00", None, None), ("24/7; PH off", "2026-09-04 10:00", None, None), ("Mo off", "2026-09-04 10:00", None, None), ("Mo[1] 10:00-12:00", "2026-09-04 10:00", None, None), ("", "2026-09-04 10:00", None, None), (None, "2026-09-04 10:00", None, None),
]


@truth("i, open_now, changes", [(i, o, c and datetime.fromisoformat(c)) for i, (_, _, o, c) in enumerate(_HOURS)])
def hours_states(spark):
    df = spark.createDataFrame([(i, s, datetime.fromisoformat(w)) for i, (s, w, _, _) in enumerate(_HOURS)], "i int, opening_hours string, at timestamp")
    return hours.with_intervals(df).select("i", hours.is_open(F.col("intervals"), F.col("at")).alias("open_now"), hours.next_change(F.col("intervals"), F.col("at")).alias("changes"))


# search, in the corpus above


def _ranked(df, n=1):
    return df.select("query_id", "id", F.row_number().over(search.W.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("place")).where(F.col("place") <= n).select("query_id", "id")


def _asked(spark, rows):
    here = {"lon": 46.6744, "lat": 24.7114, "now": datetime.fromisoformat(NOW)}
    return search.queries(spark, [here | r for r in rows])


@truth("query_id, id", [("arabic", "p4"), ("category", "p5"), ("mall", "p2"), ("typo", "p0")])
def search_first(spark):
    """The first hit: a name outranks an address, scripts meet, a typing error is mended."""
    df = corpus_of(spark)
    asked = [{"query_id": "mall", "query": "kingdom centre"}, {"query_id": "arabic", "query": "pharmacy"}, {"query_id": "typo", "query": "carbou"}, {"query_id": "category", "query": "كرسبي كريم", "category": "pharmacy"}]
    return _ranked(search.search(df, index.build(df), _asked(spark, asked)))


@truth("query_id, id", [("all", "p0"), ("all", "p1"), ("all", "p6"), ("near", "p0"), ("near", "p1"), ("open", "p0"), ("open", "p1"), ("strict", "p1")])
def search_filters(spark):
    """All hits of a word, within a radius, open on Saturday noon, and with all terms."""
    df = corpus_of(spark)
    asked = [{"query_id": "all", "query": "coffee"}, {"query_id": "near", "query": "coffee", "radius_m": 2000.0}, {"query_id": "open", "query": "coffee", "open_now": True}, {"query_id": "strict", "query": "coffee hill", "require_all_terms": True}, {"query_id": "unknown hours", "query": "zara", "open_now": True}]
    return search.search(df, index.build(df), _asked(spark, asked)).select("query_id", "id")


@truth("query_id, id", [("arabic", "p4"), ("arabic", "p5"), ("prefix", "p2"), ("prefix", "p3"), ("two", "p2"), ("two", "p3"), ("whole", "p3")])
def prefix_hits(spark):
    """By name, and by the category's synonym; all whole words must occur."""
    df = corpus_of(spark)
    asked = [{"query_id": "prefix", "query": "kingd"}, {"query_id": "two", "query": "kingdom c"}, {"query_id": "arabic", "query": "صيدل"}, {"query_id": "whole", "query": "kingdom za"}, {"query_id": "none", "query": "zz"}, {"query_id": "empty", "query": " "}]
    return search.autocomplete(df, index.build(df), _asked(spark, asked)).select("query_id", "id")


@truth("id, open_now, days", [("p0", True, 7), ("p1", True, 7), ("p2", True, 7), ("p3", None, None)])
def place_details(spark):
    df, now = corpus_of(spark), F.lit(NOW).cast("timestamp")
    rows = [search.details(df, i, now) for i in ("p0", "p1", "p2", "p3", "nope")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("id", "open_now", F.when(F.col("schedule").isNotNull(), F.size("schedule")).alias("days"))


# matching


def _objects(spark):
    rows = [
        ("node", 1, 46.67505, 24.71205, {"name": "كوفي هيل", "amenity": "cafe", "phone": "0112", "opening_hours": "24/7", "wikidata": "Q1"}),
        ("node", 2, 46.7400, 24.7800, {"name": "Coffee Hill", "amenity": "cafe"}),
        ("node", 3, 46.67411, 24.71341, {"name": "Al Faisaliah Tower", "amenity": "cafe"}),
        ("way", 4, 46.67411, 24.71341, {"name": "Caribou Coffee", "highway": "primary"}),
        ("way", 5, 46.6760, 24.7100, {"name": "Nahdi building"}),
        ("node", 6, 46.67441, 24.71141, {"name": "Kingdom Centre", "shop": "mall", "name:ar": "مركز المملكة", "contact:website": "https://other.example.com"}),
    ]
    return spark.createDataFrame(rows, "osm_type string, osm_id long, lon double, lat double, tags map<string,string>")


@truth("osm_id, poi, kind", [(1, True, "cafe"), (2, True, "cafe"), (3, True, "cafe"), (4, False, None), (5, False, None), (6, True, None)])
def object_predicates(spark):
    return _objects(spark).select("osm_id", F.coalesce(conflate.is_poi(), F.lit(False)).alias("poi"), conflate.tag("cuisine", "amenity").alias("kind"))


@truth("id, osm_id", [("p1", 1), ("p2", 6)])
def matched_places(spark):
    """A name of the other script matches; a distant namesake, a close stranger, a road and a bare building don't; one object goes to one place."""
    twin = ("q1", "Coffee Hill", None, "cafe", 46.6753, 24.7123, None, None, None, 0.5, 1, None)
    return conflate.conflate(corpus_of(spark, [twin]), _objects(spark)).select("id", "osm_id")


@truth("id, name_ar, phone, website, opening_hours, wikidata_id, osm_id, photo_url, stamped", [("p1", None, "0112", "https://hill.example.com", "24/7", "Q1", 1, "u1", True), ("p2", "مركز المملكة", None, "https://mall.example.com", "24/7", None, 6, None, True), ("p3", None, None, None, None, None, None, None, False)])
def enriched_places(spark):
    """Objects fill gaps, their hours win, entities bring photos, and matched rows are stamped."""
    e = spark.createDataFrame([("Q1", "u1", 7, "a / b"), ("Q2", "u2", 1, None)], "qid string, image_url string, sitelinks int, attribution string")
    out, _ = conflate.enrich(corpus_of(spark), _objects(spark), F.lit(NOW).cast("timestamp"), e)
    return out.where("id IN ('p1', 'p2', 'p3')").select("id", "name_ar", "phone", "website", "opening_hours", "wikidata_id", "osm_id", "photo_url", F.col("enriched_at").isNotNull().alias("stamped"))


@truth("places, matched, phone_added, opening_hours_added, wikidata_id_added, duplicates", [(7, 2, 1, 0, 1, 0)])
def enrichment_report(spark):
    _, report = conflate.enrich(corpus_of(spark), _objects(spark), F.lit(NOW).cast("timestamp"))
    return report.select("places", "matched", "phone_added", "opening_hours_added", "wikidata_id_added", "duplicates")


@truth("id, osm_id, similarity", [("p0", 1, 100.0), ("p1", 1, 70.59), ("p4", 3, 100.0)])
def geocoded_places(spark):
    """The most alike answer within 200 m; a namesake beyond and a stranger near by don't count, one shared word of two just does."""
    kind = "lat double, lon double, osm_type string, osm_id long, importance double, name string, namedetails map<string,string>, extratags map<string,string>"
    rows = [(24.7135, 46.6742, "node", 1, 0.3, "Caribou Coffee", {}, {}), (24.7140, 46.6741, "node", 2, 0.9, "Caribou", {}, {}), (24.7101, 46.6760, "way", 3, 0.1, "x", {"name:ar": "صيدلية النهدي"}, {}), (24.7200, 46.6750, "node", 4, 0.5, "Coffee Hill", {}, {}), (24.7120, 46.6750, "node", 5, 0.5, "Faisaliah", {}, {})]
    return conflate.geocode_match(corpus_of(spark), spark.createDataFrame(rows, kind)).select("id", "osm_id", F.round("similarity", 2).alias("similarity"))


# repair


@truth("id, duplicate_of, category, category_final, category_source", [("p0", None, "coffee_shop", "coffee_shop", "brand_lexicon"), ("p4", None, "pharmacy", "pharmacy", "brand_lexicon"), ("p5", None, "pharmacy", "donuts", "brand_lexicon"), ("p6", None, "cafe", "bakery", "osm"), ("q0", "p0", "coffee_shop", "coffee_shop", "brand_lexicon"), ("q1", None, "coffee_shop", "coffee_shop", "brand_lexicon")])
def repaired_places(spark):
    """Consensus, tags, brands, then duplicates: a namesake close by is marked, one across town isn't; the source category stays."""
    twins = [("q0", "Caribou Coffee", None, "coffee_shop", 46.67411, 24.71341, None, None, None, 0.5, 1, None), ("q1", "Caribou Coffee", None, "coffee_shop", 46.7400, 24.7800, None, None, None, 0.5, 1, None)]
    tags = spark.createDataFrame([("p6", {"shop": "bakery"}), ("p2", {"shop": "none"})], "id string, tags map<string,string>")
    out = quality.repair(corpus_of(spark, twins), tags)
    return out.where("id IN ('p0', 'p4', 'p5', 'p6', 'q0', 'q1')").select("id", "duplicate_of", "category", "category_final", "category_source")


@truth("clusters, conflicted_clusters, category_corrected", [(1, 1, 1)])
def consensus_counts(spark):
    more = [(f"q{i}", "Coffee Hill", None, c, 46.7, 24.7, None, None, None, 0.9, 1, None) for i, c in enumerate(("cafe", "gym"))]
    return quality.consensus_report(corpus_of(spark, more))


# overlay


@truth("id, rating, website, place_id", [("p0", 4.6, "https://c.example.com", "g2"), ("p1", 4.0, "https://hill.example.com", "g3"), ("p4", None, None, None)])
def attached_ratings(spark):
    """Rows go to the most alike place within 150 m; of several the last counts; a missing website is filled by the first."""
    kind = "pos long, place_id string, title string, lon double, lat double, rating double, reviews long, hours string, price string, website string"
    rows = [(1, "g1", "Caribou Coffee", 46.6741, 24.7134, 4.5, 10, None, None, "https://c.example.com"), (2, "g2", "Caribou Coffee Olaya", 46.6742, 24.7135, 4.6, 11, None, None, None), (3, "g3", "Coffee Hill", 46.6750, 24.7121, 4.0, 5, None, None, "https://no.example.com"), (4, "g4", "Nahdi Pharmacy", 46.70, 24.71, 1.0, 1, None, None, None)]
    out = overlay.attach_ratings(corpus_of(spark), spark.createDataFrame(rows, kind), F.lit(NOW).cast("timestamp"))
    return out.where("id IN ('p0', 'p1', 'p4')").select("id", F.col("serpapi_rating").alias("rating"), "website", F.col("serpapi_place_id").alias("place_id"))


def _pages(spark):
    """Term 0: two full pages, the second without news, then one that is never read; term 1: a short page; terms 2 and 3: a full one."""
    full = lambda a: [(f"g{i}",) for i in range(a, a + 20)]
    rows = [(0, 0, full(0)), (0, 1, full(0)), (0, 2, full(500)), (1, 0, [("g1",), ("g100",), (None,)]), (1, 1, full(700)), (2, 0, full(40)), (3, 0, full(60))]
    return spark.createDataFrame(rows, "term_no int, page int, results array<struct<place_id:string>>").withColumn("results", F.transform("results", lambda r: F.struct(r["place_id"].alias("place_id"), F.concat(F.lit("d"), r["place_id"]).alias("data_id"))))


@truth("call, places", [(1, 20), (3, 1), (4, 20)])
def swept_places(spark):
    return overlay.sweep(_pages(spark), 4, 3).groupBy("call").agg(F.count("*").alias("places"))


@truth("calls, rows, places, terms_exhausted", [(4, 63, 41, 1)])
def sweep_counts(spark):
    return overlay.sweep_report(_pages(spark), 4, 3)


@truth("id, district", [("p0", "Olaya"), ("p1", "Olaya"), ("p2", "Olaya"), ("p3", "Olaya"), ("p4", "kept"), ("p5", "Olaya"), ("p6", None)])
def box_stamps(spark):
    df = corpus_of(spark).withColumn("district", F.when(F.col("id") == "p4", "kept"))
    return districts.stamp_box(df, "Olaya", BBox(46.665, 24.700, 46.690, 24.725)).select("id", "district")


@truth("i, q, lon, lat, share", [(0, "cafe", 46.5, 24.5, 6), (1, "gym", 46.5, 24.5, 6)])
def grid_plan(spark):
    rows = [(i, r["q"], r["lon"], r["lat"], overlay.split_budget(3, 20)) for i, r in enumerate(overlay.grid_queries((46.5, 24.5), ["cafe", "gym"]))]
    return spark.createDataFrame(rows, "i int, q string, lon double, lat double, share int")


@truth("id, rating, review_count", [("p0", 4.5, 10), ("p1", None, None)])
def provided_ratings(spark):
    given = spark.createDataFrame([("p0", 4.5, 10), ("zz", 1.0, 1)], "id string, rating double, review_count int")
    return rank.with_ratings(corpus_of(spark), given).where("id IN ('p0', 'p1')").select("id", "rating", "review_count")
