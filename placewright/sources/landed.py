"""Readers of bulk Parquet and of landed JSON from map, geocoder, entity and local-search services, and of catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.geo import BBox
from placewright.functions.text import commons_url, plain
from placewright.operators.conflate import wanted
from placewright.operators.corpus import in_bulk_box
from placewright.operators.districts import CATALOG

POINT = "lat double, lon double"
BOUNDS = "minlat double, minlon double, maxlat double, maxlon double"
ELEMENTS = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,tags:map<string,string>>>"
GEOCODED = "lat string, lon string, osm_type string, osm_id bigint, importance double, name string, namedetails map<string,string>, extratags map<string,string>"
RESULT = "struct<place_id:string,data_id:string,title:string,type:string,rating:double,reviews:bigint,hours:string,open_state:string,price:string,website:string,phone:string,address:string,gps_coordinates:struct<latitude:double,longitude:double>>"


def bulk(spark: SparkSession, path: str, box: BBox | None = None) -> DataFrame:
    """Nested bulk places; the box reaches the scan as predicates on ``bbox``, which skip files' row groups."""
    df = spark.read.parquet(path)
    return df.where(in_bulk_box(box)) if box else df


def map_objects(spark: SparkSession, path: str) -> DataFrame:
    """osm_type, osm_id, lon, lat, tags (those wanted) of map elements that have a position."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    df = e.select(F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), wanted(F.coalesce("e.tags", F.create_map().cast("map<string,string>"))).alias("tags"))
    return df.where("lon IS NOT NULL AND lat IS NOT NULL")


def district_objects(spark: SparkSession, path: str) -> DataFrame:
    """Raw districts for ``derive_boxes``."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    name = lambda k: F.try_element_at("e.tags", F.lit(k))
    return e.select(F.coalesce(name("name:ar"), name("name")).alias("name"), name("name:en").alias("name_en"), name("place").alias("place_type"), F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.col("e.bounds").alias("bounds"))


def geocoded(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(GEOCODED).json(path, multiLine=True)
    return df.withColumns({"lat": F.expr("try_cast(lat AS double)"), "lon": F.expr("try_cast(lon AS double)")})


def entities(spark: SparkSession, path: str) -> DataFrame:
    """qid, image_file, image_url, sitelinks of landed entity documents; missing ones and other keys are skipped."""
    kind = "map<string,struct<missing:string,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>,sitelinks:map<string,string>>>"
    e = spark.read.schema(f"entities {kind}").json(path, multiLine=True).select(F.explode("entities").alias("qid", "e")).where(F.col("qid").startswith("Q") & F.col("e.missing").isNull())
    files = F.filter(F.transform(F.try_element_at("e.claims", F.lit("P18")), lambda c: c["mainsnak"]["datavalue"]["value"]), lambda v: v.isNotNull() & ~v.startswith("{"))
    df = e.select("qid", F.get(files, F.lit(0)).alias("image_file"), F.coalesce(F.size(F.map_keys("e.sitelinks")), F.lit(0)).alias("sitelinks"))
    return df.withColumn("image_url", commons_url(F.col("image_file"))).dropDuplicates(["qid"])


def attributions(spark: SparkSession, path: str) -> DataFrame:
    """image_file, attribution ('artist / licence') of landed image metadata."""
    kind = "struct<pages:map<string,struct<title:string,imageinfo:array<struct<extmetadata:map<string,struct<value:string>>>>>>>"
    p = spark.read.schema(f"query {kind}").json(path, multiLine=True).select(F.explode("query.pages").alias("k", "p"))
    meta = F.get(F.col("p.imageinfo"), F.lit(0))["extmetadata"]
    value = lambda k: plain(F.try_element_at(meta, F.lit(k))["value"])
    return p.select(F.regexp_replace(F.regexp_replace("p.title", "^File:", ""), "_", " ").alias("image_file"), F.nullif(F.concat_ws(" / ", value("Artist"), value("LicenseShortName")), F.lit("")).alias("attribution"))


def with_attribution(found: DataFrame, credits: DataFrame) -> DataFrame:
    return found.withColumn("_f", F.regexp_replace("image_file", "_", " ")).join(credits.select(F.col("image_file").alias("_f"), "attribution").dropDuplicates(["_f"]), "_f", "left").drop("_f")


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed local-search pages: term_no, page and their results that have a position; pages with an error are dropped."""
    df = spark.read.schema(f"term_no int, page int, error string, local_results array<{RESULT}>").json(path)
    return df.where("error IS NULL").select("term_no", "page", F.coalesce("local_results", F.array().cast(f"array<{RESULT}>")).alias("results"))


def overlay_rows(pages: DataFrame) -> DataFrame:
    """Rows for ``attach_ratings`` in arrival order."""
    rows = pages.select("term_no", "page", F.posexplode("results").alias("k", "r")).where("r.gps_coordinates.longitude IS NOT NULL")
    pos = (F.col("term_no").cast("long") * 1_000_000 + F.col("page") * 1000 + F.col("k")).alias("pos")
    return rows.select(pos, F.coalesce("r.place_id", "r.data_id").alias("place_id"), "r.title", F.col("r.gps_coordinates.longitude").alias("lon"), F.col("r.gps_coordinates.latitude").alias("lat"), "r.rating", "r.reviews", F.coalesce("r.hours", "r.open_state").alias("hours"), "r.price", "r.website")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def map_query(box: BBox, timeout: int = 60) -> str:
    """Query text for named map objects of a box, with centres."""
    area = f"{box.min_lat},{box.min_lon},{box.max_lat},{box.max_lon}"
    return f'[out:json][timeout:{timeout}];nwr["name"]({area});out center tags;'


def district_query(city_box: tuple[float, float, float, float], timeout: int = 60) -> str:
    area = ",".join(map(str, city_box))
    return f'[out:json][timeout:{timeout}];nwr["place"~"^(suburb|neighbourhood|quarter|city_district)$"]["name"]({area});out center bb tags;'
