"""A places table derived from the driver's tables, by expressions that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from placewright.operators.corpus import conform

PLACE = {
    "id": "concat('p', c_custkey)",
    "name_primary": "p_name",
    "category": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'furniture_store' WHEN 'MACHINERY' THEN 'gym' WHEN 'FURNITURE' THEN 'restaurant' WHEN 'BUILDING' THEN 'pharmacy' ELSE 'car_wash' END",
    "lon": "46.6D + ((c_custkey * 37) % 1000) / 10000.0D",
    "lat": "24.6D + ((c_custkey * 91) % 1000) / 10000.0D",
    "address_freeform": "concat(c_custkey % 50, ' King Road, ', n_name)",
    "locality": "r_name",
    "phone": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat('011 ', 2000000 + c_custkey) ELSE concat('00966', 500000000 + c_custkey) END",
    "website": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://www.instagram.com/shop' WHEN 3 THEN concat('https://shop', c_custkey, '.example.com') WHEN 4 THEN 'https://linktr.ee/shop' ELSE 'http://wa.me/966' END",
    "brand_name": "CASE WHEN c_custkey % 23 = 0 THEN 'Rotana' END",
    "confidence": "(c_custkey % 101) / 100.0D",
    "source_count": "CAST(c_custkey % 6 AS INT)",
    "opening_hours": "CASE c_custkey % 5 WHEN 0 THEN 'Mo-Su 08:00-24:00' WHEN 1 THEN '24/7' WHEN 2 THEN 'Sa-Th 09:00-02:00; Fr off' WHEN 3 THEN 'sunrise-sunset' END",
    "wikidata_sitelinks": "CASE WHEN c_custkey % 13 = 0 THEN CAST(c_custkey % 50 AS INT) END",
    "district": "n_name",
    "source": "CASE WHEN c_custkey % 9 = 0 THEN 'serpapi' ELSE 'overture' END",
    "serpapi_reviews": "CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey % 300 AS INT) END",
    "serpapi_rating": "CASE WHEN c_custkey % 9 = 0 THEN 3.0D + (c_custkey % 20) / 10.0D END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").withColumnRenamed("c_nationkey", "n_nationkey").join(t("nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey").join(t("region"), "r_regionkey")
    rows = c.withColumnRenamed("c_custkey", "p_partkey").join(t("part").select("p_partkey", "p_name"), "p_partkey").withColumnRenamed("p_partkey", "c_custkey")
    return conform(rows.selectExpr(*[f"{e} AS {n}" for n, e in PLACE.items()]))


_DOUBLE = re.compile(r"([0-9]+[.][0-9]+)D")
PLACES_SQL = "SELECT " + ", ".join(f"{_DOUBLE.sub('CAST(' + chr(92) + '1 AS DOUBLE)', e)} AS {n}" for n, e in PLACE.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = c_custkey"
