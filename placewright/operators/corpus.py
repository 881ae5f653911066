"""The canonical corpus: schema, conforming, upserts, ingest of bulk places, derived columns and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.functions import text
from placewright.functions.geo import BBox

PLACES = (
    "id string, name_primary string, name_ar string, name_en string, category string, basic_category string, taxonomy array<string>, lon double, lat double, "
    "address_freeform string, locality string, region string, postcode string, country string, phone string, website string, email string, socials array<string>, "
    "brand_name string, brand_wikidata string, confidence double, source_count int, operating_status string, osm_type string, osm_id bigint, osm_importance double, "
    "opening_hours string, wikidata_id string, wikidata_sitelinks int, photo_url string, photo_attribution string, enriched_at timestamp, prominence double, "
    "search_blob string, category_final string, category_source string, category_confidence double, duplicate_of string, serpapi_rating double, serpapi_reviews int, "
    "serpapi_hours string, serpapi_price string, serpapi_place_id string, serpapi_fetched_at timestamp, district string, source string"
)
DEFAULTS = {"source": "overture"}
INGESTED = ["id", "name_primary", "name_ar", "name_en", "category", "basic_category", "taxonomy", "lon", "lat", "address_freeform", "locality", "region", "postcode", "country", "phone", "website", "email", "socials", "brand_name", "brand_wikidata", "confidence", "source_count", "operating_status", "search_blob"]
TEXTUAL = ["name_primary", "name_ar", "name_en", "category", "basic_category", "address_freeform", "locality", "region", "postcode", "country", "phone", "website", "email", "brand_name"]


def schema() -> T.StructType:
    return T.StructType.fromDDL(PLACES)


def conform(df: DataFrame) -> DataFrame:
    """All canonical columns in order; missing ones are typed nulls or their default."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema()])


def live(df: DataFrame) -> DataFrame:
    """Rows that are no duplicate of another."""
    return df.where(F.coalesce("duplicate_of", F.lit("")) == "")


def final_category() -> Column:
    return F.coalesce("category_final", "category")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """Rows of both by key; listed columns come from ``new`` where it has the key, all others keep what ``old`` has.

    Keys are taken to be unique in ``old``; of several new rows of a key one is kept, by its values.
    """
    listed = [c for c in (columns or new.columns) if c != key]
    order = [F.col(c).cast("string") for c in listed]
    one = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").select(key, *listed).withColumn("_new", F.lit(True)).alias("n")
    both = old.alias("o").join(one, key, "full_outer")
    names = [c for c in old.columns if c != key]
    extra = [c for c in listed if c not in names]
    return both.select(key, *[(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in listed else F.col(f"o.{c}")).alias(c) for c in names], *[F.col(f"n.{c}") for c in extra])


def flatten_bulk(raw: DataFrame) -> DataFrame:
    """Nested bulk records to flat columns; centroids from bounding boxes."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    common = lambda lang: F.try_element_at("names.common", F.lit(lang))
    mid = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    return raw.select(
        "id", F.col("names.primary").alias("name_primary"), common("ar").alias("name_ar"), common("en").alias("name_en"), F.col("categories.primary").alias("category"), "basic_category",
        F.col("taxonomy.hierarchy").alias("taxonomy"), mid("bbox.xmin", "bbox.xmax").alias("lon"), mid("bbox.ymin", "bbox.ymax").alias("lat"),
        *[first("addresses")[c].alias(a) for c, a in (("freeform", "address_freeform"), ("locality", "locality"), ("region", "region"), ("postcode", "postcode"), ("country", "country"))],
        first("phones").alias("phone"), first("websites").alias("website"), first("emails").alias("email"), "socials", F.col("brand.names.primary").alias("brand_name"), F.col("brand.wikidata").alias("brand_wikidata"),
        F.col("confidence").cast("double").alias("confidence"), F.size("sources").cast("int").alias("source_count"), "operating_status",
    )


def in_bulk_box(box: BBox) -> Column:
    """Lower corners inside the box: predicates on nested columns that row groups are skipped by."""
    return F.col("bbox.xmin").between(box.min_lon, box.max_lon) & F.col("bbox.ymin").between(box.min_lat, box.max_lat)


def blob() -> Column:
    return text.search_blob(*map(F.col, ("name_primary", "name_ar", "name_en", "brand_name", "category", "address_freeform")))


def ingest(raw: DataFrame, box: BBox, min_confidence: float = 0.0, old: DataFrame | None = None) -> DataFrame:
    """Places of a box from bulk records, cleaned; with ``old``, upserted into it."""
    rows = flatten_bulk(raw.where(in_bulk_box(box) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)))
    rows = rows.withColumns({c: text.nullif_blank(F.col(c)) for c in TEXTUAL})
    rows = rows.withColumns({"search_blob": blob(), "phone": text.clean_phone(F.col("phone"))})
    return conform(upsert(old, rows, columns=INGESTED) if old is not None else rows.dropDuplicates(["id"]))


COVERED = ["name_primary", "name_ar", "phone", "website", "address_freeform", "opening_hours", "photo_url", "osm_id"]


def coverage(df: DataFrame) -> DataFrame:
    """One row: how many places, how many have each field, mean confidence."""
    return df.agg(F.count("*").alias("places"), *[F.count(c).alias(f"with_{c}") for c in COVERED], F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def top_counts(df: DataFrame, column: str | Column, n: int = 10) -> DataFrame:
    value = F.col(column) if isinstance(column, str) else column
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def street(address: Column) -> Column:
    """Last comma part of an address, at most 40 characters."""
    return F.substring(F.trim(F.element_at(F.split(address, ","), -1)), 1, 40)
