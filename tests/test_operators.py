"""Operators over a small corpus: repair, districts, index, search, conflation, overlay, sinks."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placewright.functions.geo import BBox
from placewright.operators import conflate, corpus, districts, index, leads, overlay, quality, rank, search
from placewright.sources import landed, sinks
from placewright.streaming import overlay as stream

NOW = datetime(2026, 9, 5, 12, 0)
HERE = {"lon": 46.6744, "lat": 24.7114}
ROWS = [
    ("p0", "Coffee Hill", None, "coffee_shop", 46.6750, 24.7120, "0112000000", None, "Olaya St", 0.95, 3, "Mo-Su 06:00-02:00"),
    ("p1", "مقهى الصباح", "مقهى الصباح", "cafe", 46.6760, 24.7110, "0112000001", None, "Olaya St", 0.81, 2, "Sa-Th 08:00-23:00"),
    ("p2", "Kingdom Centre", "برج المملكة", "shopping_center", 46.6742, 24.7113, None, "https://kingdom.example.com", "King Fahd Rd", 0.97, 4, "24/7"),
    ("p3", "Shoes Kingdom Centre", None, "clothing_store", 46.6743, 24.7114, None, None, "Kingdom Centre, King Fahd Rd", 0.88, 2, None),
    ("p4", "صيدلية النور", "صيدلية النور", "pharmacy", 46.6770, 24.7100, "0112000004", None, "Tahlia St", 0.90, 3, "Mo-Su 08:00-24:00"),
    ("p5", "Krispy Kreme", None, "pharmacy", 46.6730, 24.7130, "0112000005", None, "Tahlia St", 0.96, 2, None),
    ("p6", "Far Cafe", None, "cafe", 46.7700, 24.7800, "0112000006", None, "North", 0.70, 1, None),
]


@pytest.fixture(scope="module")
def places(spark):
    cols = "id string, name_primary string, name_ar string, category string, lon double, lat double, phone string, website string, address_freeform string, confidence double, source_count int, opening_hours string"
    df = corpus.conform(spark.createDataFrame(ROWS, cols))
    return rank.recompute(df).cache()


def one(df):
    return df.collect()[0]


def asked(spark, **row):
    return search.queries(spark, [{"query_id": "q", "query": "", "now": NOW} | row])


def ids(df):
    return [r["id"] for r in df.orderBy(F.desc("score"), "id").collect()]


def test_conform_and_upsert(spark, places):
    assert places.columns == [f.name for f in corpus.schema()] and len(places.columns) == 46
    new = spark.createDataFrame([("p0", "New name"), ("p9", "Added")], "id string, name_primary string")
    out = {r["id"]: r for r in corpus.upsert(places, new, columns=["name_primary"]).collect()}
    assert len(out) == 8 and out["p0"]["name_primary"] == "New name" and out["p0"]["phone"] == "0112000000" and out["p9"]["phone"] is None


def test_prominence_bounds(places):
    got = {r["id"]: r["prominence"] for r in places.collect()}
    assert all(0 <= v <= 1 for v in got.values()) and got["p2"] > got["p6"]


def test_search(spark, places):
    ix = index.build(places)
    assert ids(search.search(places, ix, asked(spark, query="kingdom centre", **HERE)))[0] == "p2"
    assert "p1" in ids(search.search(places, ix, asked(spark, query="coffee", **HERE)))
    assert ids(search.search(places, ix, asked(spark, query="krispi kreme")))[0] == "p5"
    assert "p6" not in ids(search.search(places, ix, asked(spark, query="cafe", radius_m=3000.0, **HERE)))
    assert ids(search.search(places, ix, asked(spark, query="coffee", open_now=True, category="coffee_shop", **HERE))) == ["p0"]
    assert ids(search.search(places, ix, asked(spark, query="coffee hill", require_all_terms=True))) == ["p0"]
    assert ids(search.search(places, ix, asked(spark, query="  "))) == []
    near = search.search(places, ix, asked(spark, query="  ", radius_m=2000.0, **HERE))
    assert "p2" in ids(near) and "p6" not in ids(near)


def test_nearby_autocomplete_details(spark, places):
    got = ids(search.nearby(places, asked(spark, radius_m=300.0, **HERE)))
    assert set(got) <= {"p0", "p1", "p2", "p3", "p5"} and "p2" in got
    ix = index.build(places)
    assert "p5" in ids(search.autocomplete(places, ix, asked(spark, query="kris")))
    assert ids(search.autocomplete(places, ix, asked(spark, query="kingdom cen"))) and ids(search.autocomplete(places, ix, asked(spark, query="zzz"))) == []
    row = one(search.details(places, "p1", F.lit(NOW)))
    assert row["open_now"] is True and row["schedule"][4]["closed"] is True
    hits = search.nearby(places, asked(spark, radius_m=300.0, **HERE))
    body = json.loads(one(sinks.places_json(hits.where("id = 'p2'")))["json"])
    assert body["displayName"]["text"] == "Kingdom Centre" and isinstance(body["distanceMeters"], int)
    assert json.loads(one(sinks.details_json(search.details(places, "p2", F.lit(NOW))))["json"])["openNow"] is True


def test_index_weights(places):
    ix = index.build(places)
    tf = {(r["term"], r["place_id"]): r["tf"] for r in ix.postings.collect()}
    assert tf[("kingdom", "p2")] == 3 and tf[("kingdom", "p3")] == 4 and tf[("king", "p2")] == 1
    assert {r["term"]: r["df"] for r in ix.terms.collect()}["kingdom"] == 2


def test_repair(spark, places):
    more = spark.createDataFrame([("a", "Bolt", "gym", 0.5), ("b", "bolt", "gym", 0.4), ("c", "Bolt!", "cafe", 0.8), ("d", "Lone", "cafe", 0.1), ("e", "Nut", "b", 0.3), ("f", "Nut", "a", 0.3)], "id string, name_primary string, category string, confidence double")
    out = {r["id"]: r for r in quality.harmonize(corpus.conform(more)).collect()}
    assert [out[i]["category_final"] for i in "abcdef"] == ["gym", "gym", "gym", "cafe", "a", "a"]
    assert out["c"]["category"] == "cafe" and out["c"]["category_source"] == "cluster_consensus" and out["d"]["category_source"] == "overture"
    assert one(quality.consensus_report(corpus.conform(more))).asDict() == {"clusters": 2, "conflicted_clusters": 2, "category_corrected": 2}
    fixed = {r["id"]: r["category_final"] for r in quality.apply_brands(quality.harmonize(places)).collect()}
    assert fixed["p5"] == "donuts" and fixed["p4"] == "pharmacy"
    tags = spark.createDataFrame([("p4", {"amenity": "cafe"})], "id string, tags map<string,string>")
    assert {r["id"]: r["category_final"] for r in quality.apply_tags(quality.harmonize(places), tags).collect()}["p4"] == "cafe"


def test_duplicates(spark):
    rows = [("a", "Same", 46.0, 24.0, 0.9), ("b", "same", 46.00001, 24.0, 0.5), ("c", "Same", 46.1, 24.0, 0.5), ("d", "Same", 46.00101, 24.0, 0.4), ("e", "Same", 46.00100, 24.0, 0.3), ("f", "Other", 46.0, 24.0, 0.1)]
    df = corpus.conform(spark.createDataFrame(rows, "id string, name_primary string, lon double, lat double, prominence double"))
    got = {r["id"]: r["duplicate_of"] for r in quality.mark_duplicates(df).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "a", "e": "a", "f": None}


def test_leads(places):
    got = {r["id"]: r for r in leads.find_leads(places).collect()}
    assert {"p0", "p1", "p6"} <= set(got) and not {"p2", "p3", "p5"} & set(got)
    assert got["p0"]["reasons"][0] == "no web presence at all"
    assert one(leads.find_leads(places, box=BBox(46.76, 24.77, 46.78, 24.79)))["id"] == "p6"


def test_districts(spark, places):
    raw = spark.createDataFrame([("A", "a", "suburb", "node", 1, 46.67, 24.71, None), ("B", "b", "suburb", "node", 2, 46.68, 24.71, None), ("C", None, "suburb", "way", 3, 46.9, 24.9, None)], "name string, name_en string, place_type string, osm_type string, osm_id long, lon double, lat double, bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>")
    cat = districts.derive_boxes(raw, "riyadh").cache()
    box = {r["name"]: r for r in cat.collect()}
    assert (box["C"]["max_lat"] - box["C"]["min_lat"]) * 111_000 == pytest.approx(5000) and (box["A"]["max_lat"] - box["A"]["min_lat"]) * 111_000 == pytest.approx(1400)
    got = {r["id"]: r["district"] for r in districts.stamp(places.withColumn("district", F.lit("old")), cat).collect()}
    assert got["p5"] == "A" and got["p4"] == "B" and got["p6"] == "old"
    assert one(districts.find(cat, "a"))["name"] == "A" and districts.find(cat, "").count() == 0 and districts.search(cat, "b").count() == 1


def greedy(pairs):
    left, right, out = set(), set(), []
    for d, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return sorted(out)


def test_one_to_one_equals_greedy(spark):
    import random

    for seed in range(3):
        rnd = random.Random(seed)
        pairs = [(rnd.randint(0, 5), f"a{rnd.randint(0, 8)}", f"b{rnd.randint(0, 8)}") for _ in range(25)]
        pairs = list({(a, b): (d, a, b) for d, a, b in pairs}.values())
        df = spark.createDataFrame(pairs, "d int, a string, b string")
        got = conflate.one_to_one(df, ["a"], ["b"], [F.col("d"), F.col("a"), F.col("b")])
        assert sorted((r["a"], r["b"]) for r in got.collect()) == greedy(pairs)


def test_one_to_one_hot_points(spark):
    hot = [(0, f"a{i:03}", f"b{j:03}") for i in range(130) for j in range(120)]
    more = [(1, f"a{i:03}", f"c{i:03}") for i in range(118, 130)] + [(2, "z0", "c119"), (2, "z0", "y0"), (2, "z1", "y0"), (2, "z1", "y1")]
    df = spark.createDataFrame(hot + more, "d int, a string, b string")
    got = conflate.one_to_one(df, ["a"], ["b"], [F.col("d")])
    assert got.columns == df.columns and sorted((r["a"], r["b"]) for r in got.collect()) == greedy(hot + more)
    assert conflate.one_to_one(df.limit(0), ["a"], ["b"], [F.col("d")]).count() == 0


def test_conflation_and_enrichment(spark, places):
    poi = [("node", 1, 46.6751, 24.7121, {"name": "كوفي هيل", "amenity": "cafe", "opening_hours": "24/7", "name:ar": "كوفي هيل"}), ("node", 2, 46.6761, 24.7121, {"name": "Coffee Hill", "highway": "road"}), ("node", 3, 46.80, 24.80, {"name": "Coffee Hill", "amenity": "cafe"}), ("node", 4, 46.6750, 24.7119, {"name": "Quite Different", "shop": "x"})]
    pois = spark.createDataFrame(poi, "osm_type string, osm_id long, lon double, lat double, tags map<string,string>")
    got = conflate.conflate(places, pois).collect()
    assert [(r["id"], r["osm_id"]) for r in got] == [("p0", 1)]
    entities = spark.createDataFrame([("Q1", "u", 9, "who")], "qid string, image_url string, sitelinks int, attribution string")
    after, report = conflate.enrich(places, pois, F.lit(NOW), entities)
    row = {r["id"]: r for r in after.collect()}["p0"]
    assert row["opening_hours"] == "24/7" and row["osm_id"] == 1 and row["name_ar"] == "كوفي هيل" and row["category_final"] == "cafe"
    assert one(report)["matched"] == 1 and one(report)["name_ar_added"] == 1


def test_conflation_of_kinds_equals_greedy(spark, monkeypatch):
    import random

    rnd, names = random.Random(0), ["red widget", "blue widget", "widget", "hot bolt"]
    rows = {f"p{rnd.randint(0, 400):03}": (rnd.choice(names), 46.6 + rnd.choice([0, 0.0005, 0.001]), 24.6) for _ in range(80)}
    objects = {("node" if rnd.random() < 0.5 else "way", rnd.randint(0, 300)): (46.6 + rnd.choice([0, 0.0005]), 24.6, {"name": rnd.choice(names), "shop": "x"}) for _ in range(60)}
    places = corpus.conform(spark.createDataFrame([(i, *r) for i, r in rows.items()], "id string, name_primary string, lon double, lat double"))
    pois = spark.createDataFrame([(*k, *o) for k, o in objects.items()], "osm_type string, osm_id long, lon double, lat double, tags map<string,string>")
    want = greedy([((-r["similarity"], r["dist"]), r["id"], (r["osm_type"], r["osm_id"])) for r in conflate.candidate_pairs(places, pois).collect()])
    paired, alike = [], conflate._alike
    monkeypatch.setattr(conflate, "_alike", lambda left, right: paired.append(left.count() * right.count()) or alike(left, right))
    got = conflate.conflate(places, pois)
    assert sorted((r["id"], (r["osm_type"], r["osm_id"])) for r in got.collect()) == want
    assert paired[0] <= 3 * len(names) * 2 * len(names)  # kinds meet, not rows


def test_settle_takes_the_first_right_left():
    import pyarrow as pa

    pairs = pa.table({"l": [1, 1, 2], "r": [7, 8, 8], "worse": [-90.0] * 3, "dist": [5.0] * 3})
    members = [(True, 2, 1, 1), (True, 1, 1, 2), (True, 2, 2, 3), (True, 1, 2, 4), (False, 8, 1, 1), (False, 7, 1, 2), (False, 8, 2, 3)]
    out = conflate._settle(pairs, pa.Table.from_pylist([dict(zip(("left", "kind", "at", "nth"), m)) for m in members]))
    assert [(r["l"], r["r"], r["ul"], r["ur"]) for r in out.to_pylist()] == [(2, 8, 0, 0), (1, 7, 0, 0), (2, 8, 1, 1)]


def test_conflation_query_takes_all_objects(spark):
    from placewright.plans import catalogue

    got = {r["osm_id"] for r in catalogue.QUERIES["conflation"](spark, "/root/testdata/sf0.001").collect()}
    assert {i % 3 for i in got} == {0, 1, 2}


def test_overlay(spark, places):
    rows = [(0, "g1", "Coffee Hill", 46.6750, 24.7120, 4.5, 30, "h", "$", "https://hill.example.com"), (1, "g2", "coffee  hill", 46.6751, 24.7120, 4.7, 40, "h", "$", None)]
    df = spark.createDataFrame(rows, "pos long, place_id string, title string, lon double, lat double, rating double, reviews long, hours string, price string, website string")
    out = overlay.attach_ratings(places, df, F.lit(NOW)).cache()
    row = {r["id"]: r for r in out.collect()}["p0"]
    assert row["serpapi_rating"] == 4.7 and row["serpapi_place_id"] == "g2" and row["website"] == "https://hill.example.com"
    later = F.lit(datetime(2026, 10, 30))
    assert [r["id"] for r in overlay.stale(out, later).collect()] == ["p0"]
    purged = {r["id"]: r for r in overlay.purge_stale(out, later).collect()}["p0"]
    assert purged["serpapi_rating"] is None and purged["serpapi_place_id"] == "g2"


def test_sweep_and_search_upsert(spark, places, tmp_path):
    result = lambda i, **more: {"place_id": f"g{i}", "title": f"T{i}", "type": "cafe", "gps_coordinates": {"latitude": 24.7, "longitude": 46.7}, **more}
    pages = [{"term_no": 0, "page": 0, "local_results": [result(i) for i in range(20)]}, {"term_no": 0, "page": 1, "local_results": [result(i) for i in range(18, 25)]}, {"term_no": 1, "page": 0, "local_results": [result(0), result(99, phone="0112")]}, {"term_no": 1, "page": 1, "local_results": [result(77)]}, {"term_no": 2, "page": 0, "error": "x"}]
    path = tmp_path / "pages.json"
    path.write_text("\n".join(map(json.dumps, pages)))
    landed_pages = landed.search_pages(spark, str(path))
    kept = overlay.sweep(landed_pages).cache()
    assert {r["place_id"] for r in kept.collect()} == {f"g{i}" for i in (*range(25), 99)}
    out = overlay.upsert_search_rows(places, kept, "D", F.lit(NOW))
    assert out.count() == 7 + 26 and out.where("source = 'serpapi'").first()["category_source"] == "google"
    again = overlay.upsert_search_rows(out, kept, "D", F.lit(NOW))
    assert again.count() == 33
    assert landed.overlay_rows(landed_pages).count() == 30


def test_sources(spark, tmp_path):
    objects = {"elements": [{"type": "node", "id": 1, "lat": 24.7, "lon": 46.6, "tags": {"name": "x", "amenity": "cafe", "junk": "1"}}, {"type": "way", "id": 2, "center": {"lat": 24.7, "lon": 46.6}, "tags": {"name": "y"}}, {"type": "way", "id": 3}]}
    (tmp_path / "o.json").write_text(json.dumps(objects))
    got = {r["osm_id"]: r for r in landed.map_objects(spark, str(tmp_path / "o.json")).collect()}
    assert set(got) == {1, 2} and got[1]["tags"] == {"name": "x", "amenity": "cafe"}
    entities = {"entities": {"Q1": {"claims": {"P18": [{"mainsnak": {"datavalue": {"value": "A b/c.jpg"}}}]}, "sitelinks": {"en": {}, "ar": {}}}, "Q2": {"missing": ""}, "L1": {}}}
    (tmp_path / "e.json").write_text(json.dumps(entities))
    row = one(landed.entities(spark, str(tmp_path / "e.json")))
    assert row["qid"] == "Q1" and row["sitelinks"] == 2 and row["image_url"].endswith("A_b/c.jpg")
    meta = {"query": {"pages": {"1": {"title": "File:A b.jpg", "imageinfo": [{"extmetadata": {"Artist": {"value": "<a>Me</a>"}, "LicenseShortName": {"value": "CC BY"}}}]}}}}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    assert one(landed.attributions(spark, str(tmp_path / "m.json")))["attribution"] == "Me / CC BY"
    assert "24.7,46.6" in landed.map_query(BBox(46.6, 24.7, 46.7, 24.8))


def test_bulk_ingest(spark, tmp_path):
    row = {"id": "x", "names": {"primary": " Cafe ", "common": {"ar": "مقهى"}}, "categories": {"primary": "cafe"}, "basic_category": None, "taxonomy": {"hierarchy": ["a"]}, "bbox": {"xmin": 46.67, "xmax": 46.69, "ymin": 24.71, "ymax": 24.73}, "addresses": [{"freeform": "S", "locality": "R", "region": None, "postcode": None, "country": "SA"}], "phones": ["011"], "websites": None, "emails": None, "socials": None, "brand": None, "confidence": 0.9, "sources": [{"d": "a"}, {"d": "b"}], "operating_status": "open"}
    kind = "id string, names struct<primary:string,common:map<string,string>>, categories struct<primary:string>, basic_category string, taxonomy struct<hierarchy:array<string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, addresses array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>, phones array<string>, websites array<string>, emails array<string>, socials array<string>, brand struct<names:struct<primary:string>,wikidata:string>, confidence double, sources array<struct<d:string>>, operating_status string"
    spark.createDataFrame([row, row | {"id": "far", "bbox": {"xmin": 50.0, "xmax": 50.1, "ymin": 24.0, "ymax": 24.1}}, row | {"id": "low", "confidence": 0.1}], kind).write.parquet(str(tmp_path / "bulk"))
    raw = landed.bulk(spark, str(tmp_path / "bulk"), BBox(46.6, 24.7, 46.7, 24.8))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan.split("PushedFilters")[1]
    got = corpus.ingest(landed.bulk(spark, str(tmp_path / "bulk")), BBox(46.6, 24.7, 46.7, 24.8), 0.5).collect()
    assert [r["id"] for r in got] == ["x"] and got[0]["name_primary"] == "Cafe" and got[0]["phone"] == "+96611" and got[0]["source_count"] == 2 and got[0]["lon"] == pytest.approx(46.68)
    assert one(corpus.coverage(spark.createDataFrame(got, corpus.schema())))["with_phone"] == 1


def test_csv_and_stream(spark, places, tmp_path):
    sinks.leads_csv(leads.find_leads(places), str(tmp_path / "l.csv"))
    raw = (tmp_path / "l.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,") and b"no web presence at all; " in raw
    spark.createDataFrame([("a", NOW, 4.0), ("a", NOW, 4.0), ("b", NOW, 5.0)], "place_id string, fetched_at timestamp, rating double").write.parquet(str(tmp_path / "s"))
    rows = spark.readStream.schema("place_id string, fetched_at timestamp, rating double").parquet(str(tmp_path / "s"))
    q = stream.latest_rows(rows).writeStream.format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("latest").count() == 2


def test_near_pairs_at_any_latitude(spark):
    """Every pair within the radius, up to high latitudes, where a degree of longitude is short."""
    for lat in (0.0, 24.7, 47.5, 60.0, 75.0, -68.0):
        step = 140 / (111_000 * math.cos(math.radians(lat)))
        rows = [(i, 10 + i * 0.003713, lat + (i % 7) * 0.00031) for i in range(120)]
        left = spark.createDataFrame(rows, "l int, l_lon double, l_lat double")
        right = spark.createDataFrame([(i, lon + step * (-1) ** i, at) for i, lon, at in rows], "r int, r_lon double, r_lat double")
        got = {(r["l"], r["r"]) for r in conflate.near_pairs(left, right, 150.0).collect()}
        assert got >= {(i, i) for i in range(120)}


def test_sweep_stops_a_term_without_news(spark):
    """Three full pages of a term, the second without news, budget three: the third call goes to the next term."""
    full = lambda a: [(f"g{i}", None) for i in range(a, a + 20)]
    rows = [(0, 0, full(0)), (0, 1, full(0)), (0, 2, full(100)), (1, 0, full(200)), (1, 1, full(300))]
    pages = spark.createDataFrame(rows, "term_no int, page int, results array<struct<place_id:string,data_id:string>>")
    assert [tuple(r) for r in overlay.calls(pages, 3, 3).orderBy("call").collect()] == [(1, 0, 0, 20, 20), (2, 0, 1, 20, 0), (3, 1, 0, 20, 20)]
    assert {r["place_id"] for r in overlay.sweep(pages, 3, 3).collect()} == {f"g{i}" for i in (*range(20), *range(200, 220))}
    assert overlay.sweep_report(pages, 3, 3).first().asDict() == {"calls": 3, "rows": 60, "places": 40, "terms_exhausted": 1}
    assert overlay.sweep(pages.limit(0)).count() == 0 and overlay.first_calls(pages, 2).count() == 2
