"""Prominence: how likely a place is meant, from 0 to 1."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import nullif_blank
from placewright.operators.corpus import blob

# Weights and where signals saturate.
WEIGHTS = {"confidence": 0.34, "sources": 0.16, "contact": 0.16, "importance": 0.16, "sitelinks": 0.12, "brand": 0.06}
CONTACT = {"phone": 0.40, "website": 0.35, "address_freeform": 0.25}
SOURCES_AT, SITELINKS_AT = 5, 40


def _present(*columns: str) -> Column:
    return nullif_blank(F.coalesce(*map(F.col, columns))).isNotNull().cast("int")


def _log_share(column: str, top: float) -> Column:
    n = F.greatest(F.lit(0), F.coalesce(F.col(column), F.lit(0)))
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / top)


def prominence() -> Column:
    signals = {
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "sources": _log_share("source_count", math.log(SOURCES_AT)),
        "contact": sum((w * _present(c) for c, w in CONTACT.items()), F.lit(0.0)),
        "importance": F.coalesce("osm_importance", F.lit(0.0)),
        "sitelinks": _log_share("wikidata_sitelinks", math.log1p(SITELINKS_AT)),
        "brand": _present("brand_wikidata", "brand_name"),
    }
    total = sum((WEIGHTS[k] * v for k, v in signals.items()), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def recompute(places: DataFrame) -> DataFrame:
    return places.withColumn("prominence", prominence())


def refresh_derived(places: DataFrame) -> DataFrame:
    """Search blob from the raw fields, and prominence."""
    return recompute(places.withColumn("search_blob", blob()))


def with_ratings(places: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Ratings of a provider (id, rating, review_count) where there is one, else typed nulls."""
    if ratings is None:
        return places.withColumns({"rating": F.lit(None).cast("double"), "review_count": F.lit(None).cast("int")})
    return places.join(ratings.select("id", "rating", "review_count"), "id", "left")
