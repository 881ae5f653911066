"""Named queries over the driver's tables, one for each operator, and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placewright.functions import hours, text
from placewright.functions.geo import BBox, decay, haversine_m
from placewright.functions.lexicons import BRAND_CATEGORIES, CATEGORY_FIT, CHAIN_MARKERS, DEFAULT_FIT
from placewright.functions.text import PLATFORMS
from placewright.operators import conflate, corpus, districts, index, leads, overlay, quality, rank, search
from placewright.plans import truths
from placewright.plans.views import PLACES_SQL, places, table

QUERIES: dict = {}
SQL: dict = {}
WITH = f"WITH places AS ({PLACES_SQL})"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[''`]', '', 'g'), '[^a-z0-9_]+', ' ', 'g'))"


def query(f):
    QUERIES[f.__name__] = f
    return f


def distance_sql(lon1, lat1, lon2, lat2) -> str:
    a = f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    return f"(2 * 6371000.0 * asin(sqrt(least(1.0, {a}))))"


# websites, html, phones

WEB = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 'none' " + " ".join(f"WHEN regexp_matches({{0}}, '(?i){p}') THEN '{label}'" for label, p in PLATFORMS) + " ELSE 'real site' END"


@query
def website_class(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.classify_website(F.col("url")).alias("label"))


SQL["website_class"] = f"SELECT page_id, {WEB.format('url')} AS label FROM pages"


@query
def html_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


SQL["html_plain"] = "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '') AS plain FROM pages"


@query
def phones(spark, sf_dir):
    return places(spark, sf_dir).select("id", text.clean_phone(F.col("phone")).alias("phone"))


_P = "regexp_replace(phone, '[^0-9+]', '', 'g')"
SQL["phones"] = f"{WITH} SELECT id, CASE WHEN phone IS NULL OR {_P} = '' THEN NULL WHEN starts_with({_P}, '+') THEN {_P} WHEN starts_with({_P}, '00') THEN '+' || substr({_P}, 3) WHEN starts_with({_P}, '966') THEN '+' || {_P} WHEN starts_with({_P}, '0') THEN '+966' || substr({_P}, 2) WHEN length({_P}) IN (4, 5, 9, 10) AND substr({_P}, 1, 1) IN ('9', '8') THEN {_P} ELSE '+966' || {_P} END AS phone FROM places"

# leads

FIT = "CASE coalesce(category, '') " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in CATEGORY_FIT.items()) + f" ELSE {DEFAULT_FIT} END"
CHAINED = "(coalesce(brand_name, '') <> '' OR (norm <> '' AND (branches >= 3 OR " + " OR ".join(f"contains(norm, '{m}')" for m in CHAIN_MARKERS) + " OR " + " OR ".join(f"norm = '{b}' OR starts_with(norm, '{b} ')" for b in BRAND_CATEGORIES) + ")))"
SCORED = f"""{WITH}, n AS (SELECT *, {NORM.format('name_primary')} AS norm FROM places), b AS (SELECT *, count(*) OVER (PARTITION BY norm) AS branches, {WEB.format('website')} AS web, CAST({FIT} AS DOUBLE) AS fit FROM n),
s AS (SELECT *, CASE WHEN coalesce(phone, '') = '' OR web = 'real site' OR {CHAINED} OR fit <= 0 THEN 0 ELSE least(1.0, 0.45 * (CASE WHEN web = 'none' THEN 0.75 ELSE 1 END) * fit
 + 0.35 * (CASE WHEN serpapi_reviews IS NOT NULL THEN least(1.0, ln(1 + serpapi_reviews) / ln(151)) ELSE 0.55 * confidence END) + 0.20 * fit
 + CASE WHEN serpapi_rating IS NOT NULL AND serpapi_reviews >= 20 THEN 0.1 * greatest(0, (serpapi_rating - 3.5) / 1.5) ELSE 0 END) END AS score FROM b)"""


def _varied(spark, sf_dir):
    """Places whose names are mostly their own, so that not all are chains."""
    df = places(spark, sf_dir)
    return df.withColumn("name_primary", F.when(F.substring("id", 2, 20).cast("long") % 7 != 0, F.concat("name_primary", F.lit(" "), F.col("id"))).otherwise(F.col("name_primary")))


_VARIED = SCORED.replace("WITH places AS (", "WITH places AS (SELECT * REPLACE (CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 <> 0 THEN name_primary || ' ' || id ELSE name_primary END AS name_primary) FROM (").replace("), n AS", ")), n AS", 1)


@query
def leads_rank(spark, sf_dir):
    df = leads.find_leads(_varied(spark, sf_dir), limit=None)
    return df.select("id", "name", "category", "web_presence", "fit", "score")


SQL["leads_rank"] = f"{_VARIED} SELECT id, name_primary AS name, category, web AS web_presence, fit, floor(score * 10000 + 0.5000001) / 10000 AS score FROM s WHERE score > 0 AND score >= 0.35"


@query
def leads_by_district(spark, sf_dir):
    return leads.rank_districts(_varied(spark, sf_dir)).select("district", "total", "prospects", F.round("rate", 4).alias("rate"))


SQL["leads_by_district"] = f"{_VARIED} SELECT district, count(*) AS total, count(*) FILTER (score > 0 AND score >= 0.5) AS prospects, round(100.0 * count(*) FILTER (score > 0 AND score >= 0.5) / count(*), 4) AS rate FROM s GROUP BY district"


@query
def chains(spark, sf_dir):
    return leads.chain_names(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name_primary"))


SQL["chains"] = f"SELECT {NORM.format('p_name')} AS norm, count(*) AS branches FROM part GROUP BY 1 HAVING count(*) >= 3"


@query
def filtered_counts(spark, sf_dir):
    return leads.district_status(places(spark, sf_dir))


SQL["filtered_counts"] = f"{WITH} SELECT district, count(*) AS places, count(*) FILTER (source = 'serpapi') AS google, count(*) FILTER (serpapi_reviews IS NOT NULL) AS reviewed FROM places GROUP BY district"

# prominence, coverage

PROMINENCE = "least(1.0, greatest(0.0, 0.34 * coalesce(confidence, 0) + 0.16 * least(1.0, ln(1 + coalesce(source_count, 0)) / ln(5)) + 0.16 * (0.4 * (coalesce(trim(phone), '') <> '')::INT + 0.35 * (coalesce(trim(website), '') <> '')::INT + 0.25 * (coalesce(trim(address_freeform), '') <> '')::INT) + 0.12 * least(1.0, ln(1 + coalesce(wikidata_sitelinks, 0)) / ln(41)) + 0.06 * (coalesce(trim(brand_name), '') <> '')::INT))"


@query
def prominence(spark, sf_dir):
    return rank.recompute(places(spark, sf_dir)).select("id", F.round("prominence", 6).alias("prominence"))


SQL["prominence"] = f"{WITH} SELECT id, round({PROMINENCE}, 6) AS prominence FROM places"


@query
def coverage_stats(spark, sf_dir):
    return corpus.coverage(places(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


SQL["coverage_stats"] = f"{WITH} SELECT count(*) AS places, count(name_primary) AS with_name_primary, CAST(0 AS BIGINT) AS with_name_ar, count(phone) AS with_phone, count(website) AS with_website, count(address_freeform) AS with_address_freeform, count(opening_hours) AS with_opening_hours, CAST(0 AS BIGINT) AS with_photo_url, CAST(0 AS BIGINT) AS with_osm_id, round(coalesce(avg(confidence), 0), 6) AS avg_confidence FROM places"


@query
def street_rollup(spark, sf_dir):
    return places(spark, sf_dir).groupBy(corpus.street(F.col("address_freeform")).alias("street")).agg(F.count("*").alias("n"))


SQL["street_rollup"] = f"{WITH} SELECT substr(trim(split_part(address_freeform, ',', -1)), 1, 40) AS street, count(*) AS n FROM places GROUP BY 1"


@query
def top_trades(spark, sf_dir):
    """The feature is a top-k report."""
    return corpus.top_counts(places(spark, sf_dir), "category", 3)


SQL["top_trades"] = f"{WITH} SELECT category AS value, count(*) AS n FROM places GROUP BY 1 ORDER BY n DESC, value LIMIT 3"


@query
def category_filter(spark, sf_dir):
    df = leads.candidates(places(spark, sf_dir), locality="as", categories=["gym", "restaurant"], box=BBox(46.61, 24.61, 46.68, 24.69))
    return df.select("id", "category", "locality")


SQL["category_filter"] = f"{WITH} SELECT id, category, locality FROM places WHERE locality ILIKE '%as%' AND category IN ('gym', 'restaurant') AND lon BETWEEN 46.61 AND 46.68 AND lat BETWEEN 24.61 AND 24.69"

# repair


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name_primary"), F.col("p_type").alias("category"), (F.col("p_retailprice") / 10000.0).alias("confidence"), F.lit(None).cast("string").alias("brand_name"))


_CONS = f"""WITH v AS (SELECT {NORM.format('p_name')} AS norm, p_type AS category, count(*) AS n, sum(p_retailprice / 10000.0 + 0.1) AS w FROM part GROUP BY 1, 2),
c AS (SELECT norm, sum(n) AS members, count(*) AS kinds, sum(w) AS total FROM v GROUP BY norm),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY w DESC, category) AS k FROM v)"""


@query
def category_consensus(spark, sf_dir):
    return quality.consensus(_parts(spark, sf_dir)).select("norm", "winner", F.round("strength", 6).alias("strength"), "members", "wrong")


SQL["category_consensus"] = f"{_CONS} SELECT c.norm, r.category AS winner, round(r.w / c.total, 6) AS strength, CAST(c.members AS BIGINT) AS members, CAST(c.members - r.n AS BIGINT) AS wrong FROM c JOIN r ON c.norm = r.norm AND r.k = 1 WHERE c.members >= 2 AND c.kinds >= 2"


@query
def harmonize(spark, sf_dir):
    return quality.harmonize(_parts(spark, sf_dir)).select("id", "category", "category_final", "category_source", F.round("category_confidence", 6).alias("category_confidence"))


SQL["harmonize"] = f"{_CONS}, won AS (SELECT c.norm, r.category AS winner, r.w / c.total AS strength FROM c JOIN r ON c.norm = r.norm AND r.k = 1 WHERE c.members >= 2 AND c.kinds >= 2) SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS category, coalesce(winner, p_type) AS category_final, CASE WHEN winner IS NULL THEN 'overture' ELSE 'cluster_consensus' END AS category_source, round(coalesce(strength, 1.0), 6) AS category_confidence FROM part LEFT JOIN won ON won.norm = {NORM.format('p_name')}"


_B = [b for b in BRAND_CATEGORIES if b.replace(" ", "").isalnum() and b.isascii()]


@query
def brand_lexicon(spark, sf_dir):
    names = F.array(*[F.lit(b) for b in _B])
    row = table(spark, sf_dir, "part").withColumn("name", F.concat(F.get(names, (F.col("p_partkey") % len(_B)).cast("int")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, "").otherwise("x")))
    return row.select("p_partkey", quality.brand_category(text.normalized(F.col("name"))).alias("category"))


SQL["brand_lexicon"] = "WITH n AS (SELECT p_partkey, list_value(" + ", ".join(f"'{b}'" for b in _B) + f")[CAST(p_partkey % {len(_B)} AS INT) + 1] || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name WHEN 1 THEN '' ELSE 'x' END AS name FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN name = '{b}' THEN '{c}'" for b, c in BRAND_CATEGORIES.items()) + " " + " ".join(f"WHEN starts_with(name, '{b} ') THEN '{c}'" for b, c in BRAND_CATEGORIES.items()) + " END AS category FROM n"


@query
def dedupe(spark, sf_dir):
    """Greedy by prominence; the SQL unrolls six rounds of it, more than places of one name chain up."""
    return quality.mark_duplicates(rank.recompute(places(spark, sf_dir))).select("id", "duplicate_of")


_NEAR = f"n AS (SELECT id, lon, lat, prom, {NORM.format('name_primary')} AS norm FROM (SELECT *, {PROMINENCE} AS prom FROM places)), e AS (SELECT a.id, b.id AS better, b.prom FROM n a JOIN n b ON a.norm = b.norm AND a.id <> b.id AND (b.prom > a.prom OR b.prom = a.prom AND b.id < a.id) AND {distance_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 120), k0 AS (SELECT id FROM n WHERE FALSE), d0 AS (SELECT id FROM n WHERE FALSE)"
_ROUNDS = "".join(f", k{i} AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM d{i - 1}) AND id NOT IN (SELECT id FROM e WHERE better NOT IN (SELECT id FROM d{i - 1}))), d{i} AS (SELECT DISTINCT id FROM e WHERE better IN (SELECT id FROM k{i}))" for i in range(1, 7))
SQL["dedupe"] = f"{WITH}, {_NEAR}{_ROUNDS}, l AS (SELECT e.id, arg_min(better, (-e.prom, better)) AS leader FROM e WHERE better IN (SELECT id FROM k6) GROUP BY e.id) SELECT places.id, l.leader AS duplicate_of FROM places LEFT JOIN l ON l.id = places.id"


@query
def tag_categories(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    tags = F.create_map(F.lit("shop"), F.when(F.col("p_partkey") % 2 == 0, "bakery").otherwise("none"), F.lit("amenity"), F.when(F.col("p_partkey") % 3 == 0, "cafe").otherwise(""))
    return t.select("p_partkey", quality.tag_category(tags).alias("category"))


SQL["tag_categories"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'cafe' WHEN p_partkey % 2 = 0 THEN 'bakery' END AS category FROM part"

# index and search


@query
def index_terms(spark, sf_dir):
    return index.build(places(spark, sf_dir)).terms


_TOK = f"{WITH}, f AS (SELECT id, name_primary AS v, 3 AS w FROM places UNION ALL SELECT id, brand_name, 3 FROM places UNION ALL SELECT id, category, 2 FROM places UNION ALL SELECT id, address_freeform, 1 FROM places), t AS (SELECT DISTINCT id, w, v, unnest(string_split({NORM.format('v')}, ' ')) AS raw FROM f WHERE v IS NOT NULL), x AS (SELECT id AS place_id, CASE raw WHEN 'restaurant' THEN 'مطعم' WHEN 'gym' THEN 'نادي' WHEN 'pharmacy' THEN 'صيدليه' ELSE raw END AS term, w FROM t WHERE raw <> ''), p AS (SELECT place_id, term, CAST(sum(w) AS INT) AS tf FROM x GROUP BY 1, 2)"
SQL["index_terms"] = f"{_TOK} SELECT term, CAST(count(DISTINCT place_id) AS INT) AS df FROM p GROUP BY term"


@query
def index_lengths(spark, sf_dir):
    return index.build(places(spark, sf_dir)).lengths


SQL["index_lengths"] = f"{_TOK} SELECT place_id, CAST(sum(tf) AS INT) AS len FROM p GROUP BY place_id"


def _asked(spark):
    return search.queries(spark, [{"query_id": "a", "query": "red bolt road", "lon": 46.65, "lat": 24.65}, {"query_id": "b", "query": "gym king"}, {"query_id": "c", "query": "small ring small"}])


@query
def bm25_search(spark, sf_dir):
    s = search.text_scores(_asked(spark), index.build(places(spark, sf_dir)))
    return s.select("query_id", "place_id", F.round("text_score", 6).alias("text_score"), "matched_terms", "n_terms")


SQL["bm25_search"] = f"{_TOK}, q(query_id, term) AS (VALUES ('a', 'red'), ('a', 'bolt'), ('a', 'road'), ('b', 'نادي'), ('b', 'king'), ('c', 'small'), ('c', 'ring')), l AS (SELECT place_id, sum(tf) AS len FROM p GROUP BY 1), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS a FROM l) SELECT query_id, p.place_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS text_score, count(DISTINCT q.term) AS matched_terms, (SELECT count(*) FROM q q2 WHERE q2.query_id = q.query_id) AS n_terms FROM p JOIN q ON p.term = q.term JOIN d ON d.term = p.term JOIN l ON l.place_id = p.place_id CROSS JOIN g GROUP BY q.query_id, p.place_id"


@query
def text_search(spark, sf_dir):
    """The feature is a top-k report; name similarity has no SQL twin."""
    df = rank.recompute(places(spark, sf_dir))
    return search.search(df, index.build(df), _asked(spark)).select("query_id", "id", F.round("score", 6).alias("score"))


@query
def autocomplete(spark, sf_dir):
    """The feature is a top-k report."""
    df = rank.recompute(places(spark, sf_dir))
    asked = search.queries(spark, [{"query_id": "a", "query": "red bo"}, {"query_id": "b", "query": "small"}])
    return search.autocomplete(df, index.build(df), asked).select("query_id", "id", "name", F.round("score", 6).alias("score"))


@query
def nearby(spark, sf_dir):
    """The feature is a top-k report."""
    asked = search.queries(spark, [{"query_id": "a", "query": "", "lon": 46.65, "lat": 24.65, "radius_m": 3000.0}, {"query_id": "b", "query": "", "lon": 46.62, "lat": 24.68}])
    return search.nearby(rank.recompute(places(spark, sf_dir)), asked).select("query_id", "id", F.round("distance_m", 3).alias("distance_m"), F.round("score", 6).alias("score"))


SQL["nearby"] = f"{WITH}, q(query_id, lon, lat, r) AS (VALUES ('a', 46.65, 24.65, 3000.0), ('b', 46.62, 24.68, 1000.0)), d AS (SELECT query_id, id, {distance_sql('CAST(q.lon AS DOUBLE)', 'CAST(q.lat AS DOUBLE)', 'p.lon', 'p.lat')} AS dist, {PROMINENCE} AS prom, r FROM q CROSS JOIN places p), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS k FROM d WHERE dist <= r), s AS (SELECT *, 0.6 * exp(-dist / 1500) + 0.4 * prom AS score FROM c WHERE k <= 60), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS j FROM s) SELECT query_id, id, round(dist, 3) AS distance_m, round(score, 6) AS score FROM t WHERE j <= 20"

# geography


@query
def distances(spark, sf_dir):
    d = haversine_m(F.col("lon"), F.col("lat"), 46.6744, 24.7114)
    return places(spark, sf_dir).select("id", F.round(d, 3).alias("dist"), F.round(decay(d), 6).alias("decay"))


_D = distance_sql("lon", "lat", "46.6744", "24.7114")
SQL["distances"] = f"{WITH} SELECT id, round({_D}, 3) AS dist, round(exp(-{_D} / 1500), 6) AS decay FROM places"


def _centres(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    none = "CAST(NULL AS STRUCT<minlat: DOUBLE, minlon: DOUBLE, maxlat: DOUBLE, maxlon: DOUBLE>) AS bounds"
    return n.selectExpr("n_name AS name", "n_name AS name_en", "'suburb' AS place_type", "'node' AS osm_type", "CAST(n_nationkey AS BIGINT) AS osm_id", "46.6D + (n_nationkey % 5) * 0.02D AS lon", "24.6D + floor(n_nationkey / 5) * 0.02D AS lat", none)


_CENTRES = "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS osm_id, CAST(46.6 AS DOUBLE) + (n_nationkey % 5) * CAST(0.02 AS DOUBLE) AS lon, CAST(24.6 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.02 AS DOUBLE) AS lat FROM nation"
_BOXES = f"c AS ({_CENTRES}), m AS (SELECT a.name, min({distance_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS near FROM c a JOIN c b ON a.name <> b.name GROUP BY a.name), x AS (SELECT c.*, least(2500.0, greatest(700.0, near / 2)) AS r FROM c JOIN m ON c.name = m.name), b AS (SELECT name, lon, lat, lon - r / (111000.0 * cos(radians(lat))) AS min_lon, lat - r / 111000.0 AS min_lat, lon + r / (111000.0 * cos(radians(lat))) AS max_lon, lat + r / 111000.0 AS max_lat FROM x)"


@query
def derived_boxes(spark, sf_dir):
    b = districts.with_area(districts.derive_boxes(_centres(spark, sf_dir), "city"))
    return b.select("name", *[F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat", "area_km2")])


SQL["derived_boxes"] = f"WITH {_BOXES} SELECT name, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat")) + ", round((max_lon - min_lon) * 101.0 * (max_lat - min_lat) * 111.0, 6) AS area_km2 FROM b"


@query
def city_bbox(spark, sf_dir):
    return districts.city_box(districts.derive_boxes(_centres(spark, sf_dir), "city")).select(*[F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


SQL["city_bbox"] = f"WITH {_BOXES} SELECT round(min(min_lon), 6) AS min_lon, round(min(min_lat), 6) AS min_lat, round(max(max_lon), 6) AS max_lon, round(max(max_lat), 6) AS max_lat FROM b"


@query
def district_assign(spark, sf_dir):
    return districts.assign(places(spark, sf_dir), districts.derive_boxes(_centres(spark, sf_dir), "city"))


SQL["district_assign"] = f"{WITH}, {_BOXES}, o AS (SELECT *, row_number() OVER (ORDER BY name) AS i FROM b), d AS (SELECT p.id, o.name, NOT (p.lon BETWEEN min_lon AND max_lon AND p.lat BETWEEN min_lat AND max_lat) AS outside, {distance_sql('p.lon', 'p.lat', 'o.lon', 'o.lat')} AS dist, i FROM places p CROSS JOIN o), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY outside, dist, i) AS k FROM d WHERE NOT outside OR dist <= 3000) SELECT id, name AS district FROM k WHERE k = 1"


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS s", "46.6D + ((s_suppkey * 37) % 1000) / 10000.0D AS r_lon", "24.6D + ((s_suppkey * 91) % 1000 + 3) / 10000.0D AS r_lat")


@query
def spatial_candidates(spark, sf_dir):
    left = places(spark, sf_dir).select("id", F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    return conflate.near_pairs(left, _suppliers(spark, sf_dir), 150.0).select("id", "s", F.round("dist", 3).alias("dist"))


_SUP = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS s, CAST(46.6 AS DOUBLE) + ((s_suppkey * 37) % 1000) / CAST(10000.0 AS DOUBLE) AS r_lon, CAST(24.6 AS DOUBLE) + ((s_suppkey * 91) % 1000 + 3) / CAST(10000.0 AS DOUBLE) AS r_lat FROM supplier)"
SQL["spatial_candidates"] = f"{WITH}, {_SUP}, d AS (SELECT id, s, {distance_sql('lon', 'lat', 'r_lon', 'r_lat')} AS dist FROM places CROSS JOIN s) SELECT id, s, round(dist, 3) AS dist FROM d WHERE dist <= 150"


@query
def one_to_one_match(spark, sf_dir):
    left = places(spark, sf_dir).select("id", F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    pairs = conflate.near_pairs(left, _suppliers(spark, sf_dir), 400.0).select("id", "s", "dist")
    return conflate.one_to_one(pairs, ["id"], ["s"], [F.col("dist")]).select("id", "s", F.round("dist", 3).alias("dist"))


SQL["one_to_one_match"] = f"""WITH RECURSIVE places AS ({PLACES_SQL}), {_SUP}, d AS (SELECT id, s, {distance_sql('lon', 'lat', 'r_lon', 'r_lat')} AS dist FROM places CROSS JOIN s),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist, id, s) AS k FROM d WHERE dist <= 400),
g AS (SELECT CAST(0 AS BIGINT) AS k, '' AS id, '' AS s, CAST(0 AS DOUBLE) AS dist, FALSE AS took, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS ss
  UNION ALL SELECT p.k, p.id, p.s, p.dist, NOT (list_contains(ids, p.id) OR list_contains(ss, p.s)), CASE WHEN list_contains(ids, p.id) OR list_contains(ss, p.s) THEN ids ELSE list_append(ids, p.id) END, CASE WHEN list_contains(ids, p.id) OR list_contains(ss, p.s) THEN ss ELSE list_append(ss, p.s) END FROM g JOIN p ON p.k = g.k + 1)
SELECT id, s, round(dist, 3) AS dist FROM g WHERE took"""


@query
def conflation(spark, sf_dir):
    """Fuzzy names have no SQL twin; tests pin the pairs."""
    p = places(spark, sf_dir)
    pois = table(spark, sf_dir, "part").join(p.select(F.substring("id", 2, 20).cast("long").alias("p_partkey"), "lon", "lat"), "p_partkey")
    pois = pois.select(F.lit("node").alias("osm_type"), F.col("p_partkey").alias("osm_id"), (F.col("lon") + 0.0005).alias("lon"), "lat", F.create_map(F.lit("name"), F.concat(F.lit("The "), F.initcap("p_name")), F.lit("shop"), F.lit("yes")).alias("tags"))
    return conflate.conflate(p, pois).select("id", "osm_id", F.round("similarity", 4).alias("similarity"))


# overlay, upsert, hours, json


def _landed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("p"), F.col("user_id")).alias("id"), "event_id", "ts", "value")


@query
def rating_overlay(spark, sf_dir):
    """The last landed row of each place wins."""
    last = _landed(spark, sf_dir).groupBy("id").agg(F.max_by(F.struct("ts", "value"), "event_id").alias("g"))
    return places(spark, sf_dir).join(last, "id", "left").select("id", F.coalesce("g.value", "serpapi_rating").alias("rating"), F.col("g.ts").alias("fetched_at"))


SQL["rating_overlay"] = f"{WITH}, e AS (SELECT 'p' || user_id AS id, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT places.id, coalesce(e.value, serpapi_rating) AS rating, e.ts AS fetched_at FROM places LEFT JOIN e ON e.id = places.id"


@query
def purge_stale(spark, sf_dir):
    e = _landed(spark, sf_dir).withColumnRenamed("ts", "serpapi_fetched_at").withColumn("serpapi_rating", F.col("value"))
    df = overlay.purge_stale(corpus.conform(e.withColumn("id", F.col("event_id").cast("string"))), F.lit("2024-02-15 00:00:00").cast("timestamp"))
    return df.select("id", "serpapi_rating", "serpapi_fetched_at")


SQL["purge_stale"] = "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN NOT ts < TIMESTAMP '2024-01-16 00:00:00' THEN value END AS serpapi_rating, CASE WHEN NOT ts < TIMESTAMP '2024-01-16 00:00:00' THEN ts END AS serpapi_fetched_at FROM events"


@query
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))  # known keys and a new one
    return corpus.upsert(old, new, "o_orderkey", ["o_orderstatus"])


SQL["upsert"] = "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), n AS (SELECT o_orderkey + 1 AS o_orderkey, 'X' AS o_orderstatus FROM orders) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, o.o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"


@query
def hours_open(spark, sf_dir):
    when = F.lit("2026-09-05 01:30:00").cast("timestamp")
    df = hours.with_intervals(places(spark, sf_dir))
    return df.select("id", hours.is_open(F.col("intervals"), when).alias("open_now"))


# a Saturday, 01:30; Friday is closed, so no span runs over from it
SQL["hours_open"] = f"{WITH} SELECT id, CASE opening_hours WHEN 'Mo-Su 08:00-24:00' THEN false WHEN '24/7' THEN true WHEN 'Sa-Th 09:00-02:00; Fr off' THEN false END AS open_now FROM places"


@query
def hours_schedule(spark, sf_dir):
    df = hours.with_intervals(places(spark, sf_dir).select("opening_hours").distinct())
    row = F.explode_outer(hours.schedule(F.col("intervals"))).alias("d")
    return df.select("opening_hours", row).select("opening_hours", "d.day", "d.day_en", "d.closed", F.array_join(F.transform("d.periods", lambda p: F.concat(p["open"], F.lit("-"), p["close"])), ",").alias("periods"))


SQL["hours_schedule"] = f"{WITH}, h AS (SELECT DISTINCT opening_hours FROM places), d AS (SELECT opening_hours, unnest(CASE WHEN opening_hours IS NULL OR opening_hours = 'sunrise-sunset' THEN [NULL] ELSE range(0, 7) END) AS day FROM h) SELECT opening_hours, CAST(day AS INT) AS day, ['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su'][day + 1] AS day_en, CASE WHEN day IS NOT NULL THEN opening_hours LIKE 'Sa-Th%' AND day = 4 END AS closed, CASE WHEN day IS NULL THEN NULL WHEN opening_hours = '24/7' THEN '00:00-24:00' WHEN opening_hours LIKE 'Mo-Su%' THEN '08:00-24:00' WHEN day = 4 THEN '' ELSE '09:00-02:00' END AS periods FROM d"


@query
def json_tags(spark, sf_dir):
    tags = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(tags, F.lit("k")).alias("k"), F.size(F.map_keys(tags)).alias("n"))


SQL["json_tags"] = "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INT) AS n FROM events"


@query
def tokens(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.array_join(text.tokens(F.concat("p_name", F.lit(" The "), F.col("p_name"), F.lit("'s"))), " ").alias("tokens"))


SQL["tokens"] = "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) ELSE p_name END || ' the ' || split_part(p_name, ' ', 2) || 's' AS tokens FROM part"


@query
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized(F.col("text")).cast("binary"), 256).alias("sha"))


_WORD = "regexp_replace(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[''’ʼʻ`´]', '', 'g'), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g')"
SQL["normalized_text"] = f"SELECT doc_id, sha256(trim(regexp_replace({_WORD}, '\\s+', ' ', 'g'))) AS sha FROM documents"


@query
def nearby_open(spark, sf_dir):
    """The feature is a top-k report of what is open, of twice as many candidates."""
    asked = search.queries(spark, [{"query_id": "a", "query": "", "lon": 46.65, "lat": 24.65, "radius_m": 3000.0, "open_now": True, "now": datetime(2026, 9, 5, 1, 30)}])
    return search.nearby(rank.recompute(places(spark, sf_dir)), asked).select("query_id", "id", F.round("score", 6).alias("score"))


SQL["nearby_open"] = f"{WITH}, d AS (SELECT id, opening_hours, {distance_sql('CAST(46.65 AS DOUBLE)', 'CAST(24.65 AS DOUBLE)', 'lon', 'lat')} AS dist, {PROMINENCE} AS prom FROM places), c AS (SELECT *, row_number() OVER (ORDER BY dist, id) AS k FROM d WHERE dist <= 3000), s AS (SELECT id, 0.6 * exp(-dist / 1500) + 0.4 * prom AS score FROM c WHERE k <= 160 AND opening_hours = '24/7'), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS j FROM s) SELECT 'a' AS query_id, id, round(score, 6) AS score FROM t WHERE j <= 20"

QUERIES |= truths.QUERIES
SQL |= truths.SQL
