"""Leads: businesses that are real, reachable and have no website of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.exprs import any_word, first_where, let
from placewright.functions.geo import BBox
from placewright.functions.lexicons import ARABIC_FIT, BRAND_CATEGORIES, CATEGORY_FIT, CHAIN_MARKERS, DEFAULT_FIT
from placewright.functions.text import classify_website, normalize, normalized
from placewright.operators.corpus import final_category, live

CHAIN_FROM = 3
REVIEWS_AT = 150


def category_fit(category: Column) -> Column:
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_FIT.items() for x in kv]), category)
    words = [(normalize(word), fit) for word, fit in ARABIC_FIT]
    part = let(normalized(category), lambda folded: first_where(words, lambda k: folded.contains(k)))
    return F.when(F.coalesce(category, F.lit("")) == "", DEFAULT_FIT).otherwise(F.coalesce(exact, part, F.lit(DEFAULT_FIT)))


def chain_names(places: DataFrame, threshold: int = CHAIN_FROM) -> DataFrame:
    """norm, branches of names that occur often, duplicates included."""
    named = places.where(F.col("name_primary").isNotNull()).groupBy(normalized(F.col("name_primary")).alias("norm")).agg(F.count("*").alias("branches"))
    return named.where((F.col("branches") >= threshold) & (F.col("norm") != ""))


def is_chain(norm: Column, brand_name: Column, brand_wikidata: Column, frequent: Column) -> Column:
    branded = (F.coalesce(brand_wikidata, F.lit("")) != "") | (F.coalesce(brand_name, F.lit("")) != "")
    marked, known = norm.rlike(any_word(CHAIN_MARKERS)), norm.rlike(f"^(?:{any_word(BRAND_CATEGORIES)})(?: |$)")
    return branded | ((norm != "") & (frequent | marked | known))


def score(web: Column, fit: Column, has_phone: Column, chain: Column, confidence: Column, reviews: Column, rating: Column) -> Column:
    """0 for no lead, else up to 1."""
    wish = F.when(web == "none", 0.75).otherwise(1.0)
    alive = F.when(reviews.isNotNull(), F.least(F.lit(1.0), F.log1p(reviews.cast("double")) / math.log1p(REVIEWS_AT))).otherwise(0.55 * F.coalesce(confidence, F.lit(0.0)))
    bonus = F.when(rating.isNotNull() & (F.coalesce(reviews, F.lit(0)) >= 20), 0.1 * F.greatest(F.lit(0.0), (rating - 3.5) / 1.5)).otherwise(0.0)
    total = F.least(F.lit(1.0), 0.45 * wish * fit + 0.35 * alive + 0.20 * fit + bonus)
    return F.when(~has_phone | (web == "real site") | chain | (fit <= 0), 0.0).otherwise(total)


def reasons(web: Column, category: Column, fit: Column, has_phone: Column, chain: Column, confidence: Column, reviews: Column, rating: Column) -> Column:
    trade = F.coalesce(F.nullif(category, F.lit("")), F.lit("unknown"))
    stars = F.concat(rating.cast("string"), F.lit("★"))
    well = (F.coalesce(reviews, F.lit(0)) >= 20) & (rating > 3.5)
    proof = F.when(reviews.isNotNull(), F.concat(reviews.cast("string"), F.lit(" reviews"), F.coalesce(F.when(rating != 0, F.concat(F.lit(", "), stars)), F.lit("")))).when(F.coalesce(confidence, F.lit(0.0)) != 0, F.format_string("confidence %.2f", confidence)).otherwise("unverified")
    told = F.array_compact(F.array(
        F.when(web == "none", "no web presence at all").otherwise(F.concat(web, F.lit(" only -- wants a presence, has no site"))),
        F.concat(trade, F.format_string(" (fit %.2f)", fit)), proof, F.when(well, F.concat(F.lit("well rated ("), stars, F.lit(")"))),
    ))
    one = lambda c: F.array(c)
    return F.when(~has_phone, one(F.lit("no phone -- unreachable"))).when(web == "real site", one(F.lit("already has a website"))).when(chain, one(F.lit("chain branch -- head office owns the website"))).when(fit <= 0, one(F.concat(trade, F.lit(" would not buy a website")))).otherwise(told)


def scored(places: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``places`` with norm, web_presence, fit, chain, score and reasons; chains are counted over ``corpus``."""
    df = places.withColumn("norm", normalized(F.col("name_primary")))
    chains = chain_names(corpus if corpus is not None else places).select("norm", F.lit(True).alias("_frequent"))
    df = df.join(chains, "norm", "left").withColumns({"web_presence": classify_website(F.col("website")), "final": final_category()}).withColumn("fit", category_fit(F.col("final")))
    df = df.withColumn("chain", is_chain(F.col("norm"), F.col("brand_name"), F.col("brand_wikidata"), F.coalesce("_frequent", F.lit(False))))
    phone = F.coalesce("phone", F.lit("")) != ""
    args = [phone, F.col("chain"), F.col("confidence"), F.col("serpapi_reviews"), F.col("serpapi_rating")]
    return df.withColumns({"score": score(F.col("web_presence"), F.col("fit"), *args), "reasons": reasons(F.col("web_presence"), F.col("final"), F.col("fit"), *args)}).drop("_frequent")


def candidates(places: DataFrame, locality: str | None = None, categories: list[str] | None = None, box: BBox | None = None) -> DataFrame:
    df = live(places)
    if locality:
        df = df.where(F.col("locality").ilike(f"%{locality}%"))
    if categories:
        df = df.where(final_category().isin(categories))
    return df.where(box.contains(F.col("lon"), F.col("lat"))) if box else df


def four(x: Column) -> Column:
    """Four places, halves up; a margin keeps ties of binary fractions on one side."""
    return F.floor(x * 10_000 + 0.5000001) / 10_000


def find_leads(places: DataFrame, locality: str | None = None, categories: list[str] | None = None, box: BBox | None = None, min_score: float = 0.35, limit: int | None = 200) -> DataFrame:
    """Leads, best first; ties by id."""
    df = scored(candidates(places, locality, categories, box), places).where((F.col("score") > 0) & (F.col("score") >= min_score))
    out = df.select("id", F.col("name_primary").alias("name"), "name_ar", F.col("final").alias("category"), "phone", "website", "web_presence", F.col("address_freeform").alias("address"), "district", "lon", "lat", "confidence", F.col("serpapi_rating").alias("rating"), F.col("serpapi_reviews").alias("reviews"), "fit", four(F.col("score")).alias("score"), "reasons").orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit is not None else out


def rank_districts(places: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Prospects, places and rate (percent) of each district."""
    rows = scored(live(places), places).where(F.col("district").isNotNull())
    out = rows.groupBy("district").agg(F.count("*").alias("total"), F.count_if((F.col("score") > 0) & (F.col("score") >= min_score)).alias("prospects"))
    return out.withColumn("rate", 100.0 * F.col("prospects") / F.col("total")).orderBy(F.desc("prospects"), "district")


def district_status(places: DataFrame) -> DataFrame:
    """Places, google rows and rows with reviews of each district."""
    return places.where(F.col("district").isNotNull()).groupBy("district").agg(F.count("*").alias("places"), F.count_if(F.col("source") == "serpapi").alias("google"), F.count_if(F.col("serpapi_reviews").isNotNull()).alias("reviewed")).orderBy(F.desc("places"), "district")
