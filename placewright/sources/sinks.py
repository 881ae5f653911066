"""Writers and response shapes."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import maps_url

CSV = ["name", "name_ar", "category", "phone", "web_presence", "website", "address", "district", "rating", "reviews", "score", "why", "maps_url"]


def leads_csv(leads: DataFrame, path: str) -> None:
    """A CSV for spreadsheets: byte-order mark, fixed columns, empty for null. One file, written row by row from one partition at a time."""
    out = leads.withColumns({"why": F.array_join("reasons", "; "), "maps_url": maps_url(F.col("lat"), F.col("lon"))}).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV])
    with open(path, "w", newline="", encoding="utf-8-sig") as file:
        lines = csv.writer(file, lineterminator="\n")
        lines.writerow(CSV)
        lines.writerows(out.toLocalIterator())


def leads_table(leads: DataFrame, path: str) -> None:
    """The same columns as a distributed CSV folder, for results without a limit."""
    leads.withColumns({"why": F.array_join("reasons", "; "), "maps_url": maps_url(F.col("lat"), F.col("lon"))}).select(*CSV).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def _location() -> Column:
    return F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def places_json(hits: DataFrame) -> DataFrame:
    """query_id, json: hits as nested records, distances rounded to metres and scores to four places."""
    four = lambda c: F.round(F.col(c), 4)
    body = F.struct(F.col("id"), F.struct(F.col("name").alias("text"), F.col("name_ar").alias("textAr"), F.col("name_en").alias("textEn")).alias("displayName"), F.col("category").alias("primaryType"), _location().alias("location"), F.col("address").alias("formattedAddress"), F.col("phone").alias("internationalPhoneNumber"), F.col("website").alias("websiteUri"), F.struct(F.col("open_now").alias("openNow"), F.col("opening_hours").alias("raw")).alias("currentOpeningHours"), F.struct(F.col("photo_url").alias("uri"), F.col("photo_attribution").alias("attribution")).alias("photo"), F.round("distance_m").cast("int").alias("distanceMeters"), four("prominence").alias("prominence"), four("score").alias("score"), F.transform_values("debug", lambda k, v: F.round(v, 4)).alias("debug"))
    return hits.select("query_id", F.to_json(body).alias("json"))


def suggestions_json(hits: DataFrame) -> DataFrame:
    body = F.struct(F.struct(F.col("id").alias("placeId"), F.col("name").alias("text"), F.col("name_ar").alias("textAr"), F.col("category").alias("primaryType"), F.round("distance_m").cast("int").alias("distanceMeters")).alias("placePrediction"))
    return hits.select("query_id", F.to_json(body).alias("json"))


def details_json(rows: DataFrame) -> DataFrame:
    week = F.transform("schedule", lambda d: F.concat(d["day_en"], F.lit(": "), F.when(d["closed"], "Closed").otherwise(F.array_join(F.transform(d["periods"], lambda p: F.concat(p["open"], F.lit("-"), p["close"])), ", "))))
    parts = F.struct(*[F.col(c) for c in ("address_freeform", "locality", "region", "postcode", "country")])
    body = F.struct("id", F.col("name_primary").alias("name"), "name_ar", "name_en", F.coalesce("category_final", "category").alias("primaryType"), F.col("category_source").alias("categorySource"), F.round("category_confidence", 4).alias("categoryConfidence"), _location().alias("location"), parts.alias("addressComponents"), "phone", "website", F.col("open_now").alias("openNow"), week.alias("weekdayDescriptions"), F.struct("source", "osm_type", "osm_id", "wikidata_id").alias("sources"))
    return rows.select("id", F.to_json(body).alias("json"))
