"""Districts: boxes for centres without extent, lookup by name, and assignment of places."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.functions.geo import area_km2, clamp, haversine_m
from placewright.functions.text import normalize, normalized

MIN_M, MAX_M, LONE_M, ASSIGN_M = 700.0, 2500.0, 1200.0, 3000.0
CATALOG = "name string, name_en string, city string, lon double, lat double, min_lon double, min_lat double, max_lon double, max_lat double, place_type string, osm_type string, osm_id bigint, bbox_source string"
#: A catalogue is one city's list of some hundred districts; larger ones are refused rather than broadcast.
MOST_DISTRICTS = 20_000


def _checked(districts: DataFrame) -> DataFrame:
    if districts.limit(MOST_DISTRICTS + 1).count() > MOST_DISTRICTS:
        raise ValueError(f"more than {MOST_DISTRICTS} districts")
    return districts


def derive_boxes(raw: DataFrame, city: str) -> DataFrame:
    """Catalogue rows from centres with optional ``bounds``: a derived box reaches half way to the nearest other centre."""
    rows = _checked(raw.where("name IS NOT NULL AND name <> ''").withColumn("bounds", F.when(F.col("bounds").isNotNull(), F.col("bounds"))))
    b = F.col("bounds")
    rows = rows.withColumns({"lon": F.coalesce((b["minlon"] + b["maxlon"]) / 2, "lon"), "lat": F.coalesce((b["minlat"] + b["maxlat"]) / 2, "lat")}).where("lon IS NOT NULL AND lat IS NOT NULL")
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("name", "osm_type", "osm_id")))
    here, there = rows.alias("a"), F.broadcast(rows.select("_i", "lon", "lat")).alias("b")
    near = here.join(there, F.col("a._i") != F.col("b._i")).groupBy(F.col("a._i").alias("_i")).agg(F.min(haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))).alias("near"))
    rows = rows.join(near, "_i", "left")
    radius = F.coalesce(clamp(F.col("near") / 2, MIN_M, MAX_M), F.lit(LONE_M))
    dlat, dlon = radius / 111_000.0, radius / (111_000.0 * F.cos(F.radians("lat")))
    pick = lambda own, derived: F.when(b.isNotNull(), own).otherwise(derived)
    return rows.select("name", "name_en", F.lit(city).alias("city"), "lon", "lat", pick(b["minlon"], F.col("lon") - dlon).alias("min_lon"), pick(b["minlat"], F.col("lat") - dlat).alias("min_lat"), pick(b["maxlon"], F.col("lon") + dlon).alias("max_lon"), pick(b["maxlat"], F.col("lat") + dlat).alias("max_lat"), "place_type", "osm_type", "osm_id", F.when(b.isNotNull(), "osm").otherwise("derived").alias("bbox_source")).orderBy("name", "osm_type", "osm_id")


def city_box(districts: DataFrame) -> DataFrame:
    return districts.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def with_area(districts: DataFrame) -> DataFrame:
    return districts.withColumns({"area_km2": area_km2(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")), "label": F.when(F.coalesce("name_en", F.lit("")) != "", F.concat("name", F.lit(" ("), "name_en", F.lit(")"))).otherwise(F.col("name"))})


def find(districts: DataFrame, name: str) -> DataFrame:
    """Best district of a name: equal once normalised, else one name holds the other; first in the catalogue's order."""
    key = normalize(name)
    if not key:
        return districts.limit(0)
    rows = districts.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("name", "osm_type", "osm_id"))).withColumns({"_a": normalized(F.col("name")), "_b": normalized(F.col("name_en"))})
    equal = (F.col("_a") == key) | (F.col("_b") == key)
    hay = F.concat_ws(" ", "_a", "_b")
    inside = hay.contains(key) | ((F.col("_a") != "") & F.lit(key).contains(F.col("_a")))
    return rows.where(equal | inside).orderBy((~equal).cast("int"), "_i").limit(1).drop("_i", "_a", "_b")


def search(districts: DataFrame, text: str) -> DataFrame:
    hay = F.concat_ws(" ", normalized(F.col("name")), normalized(F.col("name_en")))
    return districts.where(hay.contains(normalize(text)))


def assign(places: DataFrame, districts: DataFrame) -> DataFrame:
    """id, district: of the boxes that hold a place the one of nearest centre, else the nearest within 3 km.

    Every place meets only the districts of its own and neighbouring grid cells, so the work follows the places.
    """
    rows = _checked(districts).withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("name", "osm_type", "osm_id")))
    size = 0.05
    pad = F.lit(ASSIGN_M / 110_000.0)
    wide = F.lit(ASSIGN_M) / (110_000.0 * F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + 0.1)))))
    span = lambda low, high: F.sequence(F.floor(low / size), F.floor(high / size))
    rows = rows.select("name", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), "min_lon", "min_lat", "max_lon", "max_lat", "_i", F.explode(span(F.least("min_lon", F.col("lon") - wide), F.greatest("max_lon", F.col("lon") + wide))).alias("cx"), span(F.least("min_lat", F.col("lat") - pad), F.greatest("max_lat", F.col("lat") + pad)).alias("_cy")).withColumn("cy", F.explode("_cy")).drop("_cy")
    at = places.select("id", "lon", "lat", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
    inside = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    dist = haversine_m(F.col("lon"), F.col("lat"), F.col("d_lon"), F.col("d_lat"))
    met = at.join(rows, ["cx", "cy"]).withColumns({"_out": (~inside).cast("int"), "_d": dist}).where((F.col("_out") == 0) | (F.col("_d") <= ASSIGN_M))
    return met.groupBy("id").agg(F.min_by("name", F.struct("_out", "_d", "_i")).alias("district"))


def stamp(places: DataFrame, districts: DataFrame) -> DataFrame:
    """Places with their district; those near none keep what they had."""
    new = assign(places, districts).withColumnRenamed("district", "_new")
    return places.join(new, "id", "left").withColumn("district", F.coalesce("_new", "district")).drop("_new")


def stamp_box(places: DataFrame, name: str, box) -> DataFrame:
    """Names the places of a box that have no district yet."""
    here = F.col("district").isNull() & box.contains(F.col("lon"), F.col("lat"))
    return places.withColumn("district", F.when(here, name).otherwise(F.col("district")))


