"""Text, nearby and prefix search for many queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.functions import hours
from placewright.functions.fuzzy import best_ratio, weighted_ratio
from placewright.functions.geo import decay, haversine_m, near_box
from placewright.functions.text import normalized, tokens
from placewright.operators.corpus import final_category, live
from placewright.operators.index import Index

K1, B = 1.2, 0.75
CUTOFF = 82.0
WEIGHTS = {"text": 0.42, "name": 0.16, "distance": 0.22, "prominence": 0.20}
PREFIX_WEIGHTS = {"text": 0.15, "name": 0.35, "distance": 0.2, "prominence": 0.3}
QUERY = "query_id string, query string, lon double, lat double, radius_m double, category string, open_now boolean, now timestamp, require_all_terms boolean"
HIT = ["name_primary", "name_ar", "name_en", "brand_name", "lon", "lat", "address_freeform", "phone", "website", "photo_url", "photo_attribution", "opening_hours", "prominence"]
#: Queries in one call; the query side is broadcast within this bound.
MOST_QUERIES = 10_000


def queries(spark, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in QUERY.split(", ")]
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    return spark.createDataFrame([tuple({"open_now": False, "require_all_terms": False, "query_id": str(i)} .get(c) if r.get(c) is None else r[c] for c in names) for i, r in enumerate(rows)], QUERY)


def bm25(n: Column, df: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def query_terms(asked: DataFrame, index: Index) -> DataFrame:
    """query_id, term, times: tokens, each unknown one replaced by the best vocabulary term above the cutoff.

    Unknown terms meet only the vocabulary that shares a trigram with them or has two characters or fewer in common reach; the
    best score wins, then the least term.
    """
    raw = asked.select("query_id", F.explode(tokens(F.col("query"))).alias("raw"))
    known = raw.join(index.terms.select(F.col("term").alias("raw")), "raw", "left_semi").select("query_id", F.col("raw").alias("term"))
    unknown = raw.join(index.terms.select(F.col("term").alias("raw")), "raw", "left_anti")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    words = F.broadcast(unknown.select("raw").distinct())
    # a score above the cutoff needs a shared letter: terms are blocked by letter, then compared once
    left = words.select("raw", F.explode(letters(F.col("raw"))).alias("k")).where("k <> ''")
    right = index.terms.select("term", F.explode(letters(F.col("term"))).alias("k")).where("k <> ''")
    pairs = right.join(left, "k").groupBy("raw", "term").agg(F.count("*").alias("shared"))
    need = F.least(F.size(letters(F.col("raw"))), F.size(letters(F.col("term")))) * 0.5
    scored = pairs.where(F.col("shared") >= need).withColumn("s", weighted_ratio(F.col("raw"), F.col("term"))).where(F.col("s") >= CUTOFF)
    best = scored.groupBy("raw").agg(F.min_by("term", F.struct((-F.col("s")).alias("s"), "term")).alias("term"))
    repaired = unknown.join(best, "raw", "left").select("query_id", F.coalesce("term", "raw").alias("term"))
    return known.union(repaired).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def text_scores(asked: DataFrame, index: Index) -> DataFrame:
    """query_id, place_id, text_score, matched_terms, n_terms."""
    spark = asked.sparkSession
    # the terms of at most MOST_QUERIES queries and one row of statistics become literals of the plan that scans postings
    found = query_terms(asked, index).join(index.terms, "term", "left").select("query_id", "term", "times", "df").collect()
    n, avgdl = index.lengths.agg(F.count("*"), F.avg("len")).first()
    terms = spark.createDataFrame(found, "query_id string, term string, times long, df int")
    counts = terms.groupBy("query_id").agg(F.sum("times").alias("n_terms"))
    rows = index.postings.join(F.broadcast(terms), "term").join(index.lengths, "place_id")
    rows = rows.withColumn("s", F.col("times") * bm25(F.lit(n), F.col("df"), F.col("tf"), F.col("len"), F.lit(avgdl)))
    out = rows.groupBy("query_id", "place_id").agg(F.sum("s").alias("text_score"), F.countDistinct("term").alias("matched_terms"))
    return out.join(F.broadcast(counts), "query_id")


def _cut(df: DataFrame, order: list[Column], most: int, limit: Column | None = None) -> DataFrame:
    """First rows of each query. The literal bound lets every task keep only so many before the shuffle; ``limit`` may be tighter."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("_rank") <= most)
    return (ranked if limit is None else ranked.where(F.col("_rank") <= limit)).drop("_rank")


def _opened(df: DataFrame) -> DataFrame:
    """Open state by the query's clock; rows not known to be open go where only open ones are asked for."""
    df = hours.with_intervals(df)
    df = df.withColumn("is_open", hours.is_open(F.col("intervals"), F.col("now"))).drop("intervals")
    return df.where(~F.coalesce("open_now", F.lit(False)) | F.coalesce("is_open", F.lit(False)))


def blended(text_norm: Column, name: Column, prominence: Column, distance: Column, weights: dict) -> Column:
    base = weights["text"] * text_norm + weights["name"] * name + weights["prominence"] * F.coalesce(prominence, F.lit(0.0))
    share = (weights["text"] + weights["name"] + weights["prominence"]) or 1.0
    return F.when(distance.isNull(), base / share).otherwise(base + weights["distance"] * decay(distance))


def _hits(places: DataFrame) -> DataFrame:
    return live(places).select(F.col("id").alias("place_id"), final_category().alias("final"), *HIT)


def _name_score(query_norm: Column) -> Column:
    return best_ratio(query_norm, F.array(*[normalized(F.col(c)) for c in ("name_primary", "name_ar", "name_en", "brand_name")]))


def _shape(df: DataFrame) -> DataFrame:
    debug = F.create_map(F.lit("text_norm"), "text_norm", F.lit("name"), "name_score", F.lit("geo"), decay(F.col("distance_m")), F.lit("prominence"), F.coalesce("prominence", F.lit(0.0)))
    return df.select("query_id", F.col("place_id").alias("id"), F.col("name_primary").alias("name"), "name_ar", "name_en", F.col("final").alias("category"), "lon", "lat", F.col("address_freeform").alias("address"), "phone", "website", "photo_url", "photo_attribution", "opening_hours", F.col("is_open").alias("open_now"), "prominence", "distance_m", "text_score", "score", debug.alias("debug"))


def search(places: DataFrame, index: Index, asked: DataFrame, limit: int = 20, weights: dict | None = None) -> DataFrame:
    """Best ``limit`` places of each query: candidates by text, cut, then blended with name, distance and prominence.

    The cut before blending is part of the semantics. Queries without tokens but with a position are answered by ``nearby``.
    """
    w = WEIGHTS | (weights or {})
    asked = asked.withColumn("_some", F.size(tokens(F.col("query"))) > 0)
    q = F.broadcast(asked.where("_some").select("query_id", "query", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "radius_m", F.col("category").alias("q_category"), "open_now", "now", "require_all_terms"))
    df = text_scores(asked.where("_some"), index).join(_hits(places), "place_id").join(q, "query_id")
    df = df.withColumn("distance_m", haversine_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")))
    df = df.where((~F.coalesce("require_all_terms", F.lit(False)) | (F.col("matched_terms") >= F.col("n_terms"))) & (F.col("q_category").isNull() | (F.col("final") == F.col("q_category"))))
    df = df.where((F.coalesce("radius_m", F.lit(0.0)) == 0) | F.col("q_lon").isNull() | F.col("q_lat").isNull() | (F.col("distance_m") <= F.col("radius_m")))
    df = _cut(df, [F.desc("text_score"), F.col("place_id")], 8 * limit, F.when(F.coalesce("open_now", F.lit(False)), 8 * limit).otherwise(4 * limit))
    top = F.max("text_score").over(W.partitionBy("query_id"))
    df = _opened(df.withColumn("text_norm", F.coalesce(F.col("text_score") / F.nullif(top, F.lit(0.0)), F.lit(0.0))))
    df = df.withColumn("name_score", _name_score(normalized(F.col("query")))).withColumn("score", blended(F.col("text_norm"), F.col("name_score"), F.col("prominence"), F.col("distance_m"), w))
    out = _shape(_cut(df, [F.desc("score"), F.col("place_id")], limit))
    rest = asked.where("NOT _some AND lon IS NOT NULL AND lat IS NOT NULL").drop("_some")
    return out if rest.isEmpty() else out.unionByName(nearby(places, rest, limit, keep_radius=True))


def nearby(places: DataFrame, asked: DataFrame, limit: int = 20, radius_m: float = 1000.0, keep_radius: bool = False) -> DataFrame:
    """Places around each query's position: nearest first, cut, then ranked by distance and prominence."""
    radius = F.col("radius_m") if keep_radius else F.coalesce("radius_m", F.lit(radius_m))
    q = asked.select("query_id", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), radius.alias("radius_m"), F.col("category").alias("q_category"), "open_now", "now")
    size = 0.05  # blocks of some 5 km; a query meets the blocks that its circle touches
    span = lambda at, reach: F.sequence(F.floor((at - reach) / size), F.floor((at + reach) / size))
    dlat = F.coalesce("radius_m", F.lit(0.0)) / 110_000.0
    dlon = dlat / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs("q_lat") + dlat))))
    limited = q.where("radius_m > 0").select("*", F.explode(span(F.col("q_lon"), dlon)).alias("cx"), span(F.col("q_lat"), dlat).alias("_cy")).withColumn("cy", F.explode("_cy")).drop("_cy")
    rows = _hits(places).withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    df = rows.join(F.broadcast(limited), ["cx", "cy"]).drop("cx", "cy")
    free = q.where("coalesce(radius_m, 0) <= 0")
    df = df.unionByName(_hits(places).join(F.broadcast(free), F.lit(True)))  # a query without radius asks for every place
    df = df.withColumn("distance_m", haversine_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")))
    df = df.where((F.coalesce("radius_m", F.lit(0.0)) <= 0) | (F.col("distance_m") <= F.col("radius_m"))).where(F.col("q_category").isNull() | (F.col("final") == F.col("q_category")))
    df = _opened(_cut(df, [F.col("distance_m"), F.col("place_id")], 8 * limit, F.when(F.coalesce("open_now", F.lit(False)), 8 * limit).otherwise(3 * limit)))
    df = df.withColumns({"text_norm": F.lit(0.0), "name_score": F.lit(0.0), "text_score": F.lit(0.0), "score": 0.6 * decay(F.col("distance_m")) + 0.4 * F.coalesce("prominence", F.lit(0.0))})
    return _shape(_cut(df, [F.desc("score"), F.col("place_id")], limit))


def autocomplete(places: DataFrame, index: Index, asked: DataFrame, limit: int = 8) -> DataFrame:
    """Places with all complete tokens of a query and a term that begins with its last; ``_`` stands for any character."""
    q = asked.select("query_id", "query", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "now", F.lit(False).alias("open_now"), tokens(F.col("query"), expand=False).alias("t")).where(F.size("t") > 0)
    whole = q.select("query_id", F.explode(F.slice("t", 1, F.size("t") - 1)).alias("term"))
    last = q.select("query_id", F.regexp_replace(F.element_at("t", -1), "_", ".").alias("pattern"), F.regexp_extract(F.element_at("t", -1), "^[^_]*", 0).alias("head"))
    terms = index.terms.join(F.broadcast(last), F.col("term").startswith(F.col("head"))).where(F.expr("term rlike concat('^', pattern)")).select("query_id", "term")
    ids = index.postings.join(F.broadcast(terms), "term").select("query_id", "place_id").distinct()
    need = whole.groupBy("query_id").agg(F.count("*").alias("need"))
    met = index.postings.join(F.broadcast(whole), "term").groupBy("query_id", "place_id").agg(F.countDistinct("term").alias("met"))
    ids = ids.join(F.broadcast(need), "query_id", "left").join(met, ["query_id", "place_id"], "left").where(F.coalesce("need", F.lit(0)) <= F.coalesce("met", F.lit(0)))
    df = ids.join(_hits(places), "place_id").join(F.broadcast(q.drop("t")), "query_id").withColumn("distance_m", haversine_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")))
    df = _opened(_cut(df, [F.desc_nulls_last("prominence"), F.col("place_id")], 3 * limit))
    df = df.withColumns({"text_norm": F.lit(1.0), "text_score": F.lit(1.0), "name_score": _name_score(normalized(F.col("query")))})
    df = df.withColumn("score", blended(F.col("text_norm"), F.col("name_score"), F.col("prominence"), F.col("distance_m"), PREFIX_WEIGHTS))
    return _shape(_cut(df, [F.desc("score"), F.col("place_id")], limit))


def details(places: DataFrame, place_id: str, now: Column) -> DataFrame:
    """One place, duplicates included, with its open state and week."""
    df = hours.with_intervals(places.where(F.col("id") == place_id))
    return df.withColumns({"open_now": hours.is_open(F.col("intervals"), now), "schedule": hours.schedule(F.col("intervals"))}).drop("intervals")


__all__ = ["autocomplete", "blended", "bm25", "details", "near_box", "nearby", "queries", "query_terms", "search", "text_scores"]
