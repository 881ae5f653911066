"""The ratings overlay: matching landed search rows to places, sweeping pages into the corpus, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.functions.fuzzy import best_set_ratio
from placewright.functions.text import clean_phone, match_variants
from placewright.operators.conflate import RATING_M, RATING_SCORE, near_pairs
from placewright.operators.corpus import conform

TTL_DAYS = 30
EXPIRING = ["serpapi_rating", "serpapi_reviews", "serpapi_hours", "serpapi_price", "serpapi_fetched_at"]
PAGE_SIZE = 20


def attach_ratings(places: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Each search row (pos, place_id, title, lon, lat, rating, reviews, hours, price, website) goes to the most alike place within
    150 m, similarity 72 or more; several may go to one place, where the last in ``pos`` order counts. A missing website is filled."""
    left = places.select("id", F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"), match_variants(F.col("name_primary"), F.col("name_ar"), F.col("name_en")).alias("l_names"))
    right = rows.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat").withColumn("r_names", match_variants(F.col("title")))
    pairs = near_pairs(left, right, RATING_M).withColumn("s", best_set_ratio(F.col("l_names"), F.col("r_names"))).where(F.col("s") >= RATING_SCORE)
    best = pairs.withColumn("_n", F.row_number().over(W.partitionBy("pos").orderBy(F.desc("s"), "id"))).where("_n = 1")
    last = best.groupBy("id").agg(F.max_by(F.struct("rating", "reviews", "hours", "price", F.col("place_id").alias("pid"), "website"), "pos").alias("g"), F.min_by("website", F.when(F.coalesce("website", F.lit("")) != "", F.col("pos"))).alias("site"))
    df = places.join(last, "id", "left")
    hit = F.col("g").isNotNull()
    new = {"serpapi_rating": F.col("g.rating"), "serpapi_reviews": F.col("g.reviews").cast("int"), "serpapi_hours": F.col("g.hours"), "serpapi_price": F.col("g.price"), "serpapi_place_id": F.col("g.pid"), "serpapi_fetched_at": now}
    df = df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()} | {"website": F.coalesce("website", "site")})
    return df.drop("g", "site")


def calls(pages: DataFrame, max_calls: int = 20, pages_per_term: int = 2) -> DataFrame:
    """call, term_no, page, n (results), news (places no earlier call gave), of the pages a budgeted sweep calls for, in order.

    A term ends at a page without news, at a short one, or at its last; the sweep ends with the budget. Each call depends on all
    before it, but only the pages of the first ``max_calls`` terms can be called, and of these only keys come to the driver.
    """
    own = pages.where(F.col("page") < pages_per_term)
    terms = [r[0] for r in own.select("term_no").distinct().orderBy("term_no").limit(max_calls).collect()]
    keys = F.transform("results", lambda r: F.coalesce(r["place_id"], r["data_id"]))
    landed = own.where(F.col("term_no").isin(terms)).select("term_no", "page", keys.alias("keys")).orderBy("term_no", "page").collect()
    made, seen, ended = [], set(), set()
    for r in landed:
        if len(made) == max_calls:
            break
        if r["term_no"] in ended:
            continue
        fresh = {k for k in r["keys"] if k} - seen
        seen |= fresh
        made.append((len(made) + 1, r["term_no"], r["page"], len(r["keys"]), len(fresh)))
        if not fresh or len(r["keys"]) < PAGE_SIZE:
            ended.add(r["term_no"])
    return pages.sparkSession.createDataFrame(made, "call int, term_no int, page int, n int, news int")


def sweep(pages: DataFrame, max_calls: int = 20, pages_per_term: int = 2) -> DataFrame:
    """Rows that a budgeted sweep over landed pages (term_no, page, results) keeps: each place once, of the first call that gave it."""
    made = calls(pages, max_calls, pages_per_term).select("call", "term_no", "page")
    rows = pages.join(F.broadcast(made), ["term_no", "page"]).select("call", F.posexplode("results").alias("pos", "r"))
    key = F.coalesce("r.place_id", "r.data_id")
    first = W.partitionBy(key).orderBy("call", "pos")
    return rows.where(key.isNotNull() & (key != "")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("call", "pos", "r.*")


def sweep_report(pages: DataFrame, max_calls: int = 20, pages_per_term: int = 2) -> DataFrame:
    """calls, rows, places and terms ended by a page without news, in one row."""
    made = calls(pages, max_calls, pages_per_term)
    return made.agg(F.count("*").alias("calls"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("news"), F.lit(0)).alias("places"), F.count_if(F.col("news") == 0).alias("terms_exhausted"))


def first_calls(pages: DataFrame, max_calls: int) -> DataFrame:
    """The pages that the first calls of a budget give, in order of terms and pages."""
    return pages.orderBy("term_no", "page").limit(max_calls)


def upsert_search_rows(places: DataFrame, rows: DataFrame, district: str, now: Column) -> DataFrame:
    """Search rows with coordinates update the place of their key or become places of their own, under a stable id."""
    gps = F.col("gps_coordinates")
    new = rows.withColumn("key", F.coalesce("place_id", "data_id")).where(gps["latitude"].isNotNull() & gps["longitude"].isNotNull() & F.col("key").isNotNull())
    new = new.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(*[c for c in ("call", "pos") if c in rows.columns], "title", "address"))).where("_n = 1")
    new = new.select("key", F.col("title").alias("g_name"), F.col("type").alias("g_category"), gps["longitude"].alias("g_lon"), gps["latitude"].alias("g_lat"), clean_phone(F.col("phone")).alias("g_phone"), F.col("website").alias("g_site"), F.col("address").alias("g_address"), F.col("rating").alias("g_rating"), F.col("reviews").cast("int").alias("g_reviews"), F.coalesce("hours", "open_state").alias("g_hours"), F.col("price").alias("g_price"))
    known = places.join(new, F.col("serpapi_place_id") == F.col("key"), "left")
    hit = F.col("key").isNotNull()
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    fresh = {"serpapi_rating": F.col("g_rating"), "serpapi_reviews": F.col("g_reviews"), "serpapi_hours": F.col("g_hours"), "serpapi_price": F.col("g_price"), "serpapi_fetched_at": now, "phone": F.coalesce("phone", "g_phone"), "website": F.coalesce("website", "g_site"), "district": F.coalesce("district", F.lit(district))}
    updated = known.select(*[put(c, fresh[c]) if c in fresh else F.col(c) for c in places.columns])
    added = new.join(places.select(F.col("serpapi_place_id").alias("key")).where("key IS NOT NULL").distinct(), "key", "left_anti")
    added = added.select(F.sha2("key", 256).alias("id"), F.col("g_name").alias("name_primary"), F.when(F.col("g_name").rlike("[\\u0600-\\u06FF]"), F.col("g_name")).alias("name_ar"), F.col("g_category").alias("category"), F.col("g_category").alias("category_final"), F.lit("google").alias("category_source"), F.col("g_lon").alias("lon"), F.col("g_lat").alias("lat"), F.col("g_phone").alias("phone"), F.col("g_site").alias("website"), F.col("g_address").alias("address_freeform"), F.lit(0.95).alias("confidence"), F.lit(1).alias("source_count"), F.col("g_rating").alias("serpapi_rating"), F.col("g_reviews").alias("serpapi_reviews"), F.col("g_hours").alias("serpapi_hours"), F.col("g_price").alias("serpapi_price"), F.col("key").alias("serpapi_place_id"), now.alias("serpapi_fetched_at"), F.lit(district).alias("district"), F.lit("serpapi").alias("source"))
    return updated.unionByName(conform(added).select(*places.columns))


def stale(places: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    return places.where(F.col("serpapi_fetched_at") < now - F.make_dt_interval(F.lit(days))).select("id")


def purge_stale(places: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Clears five overlay columns past their time; the key stays."""
    old = F.coalesce(F.col("serpapi_fetched_at") < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return places.withColumns({c: F.when(~old, F.col(c)) for c in EXPIRING})


def grid_queries(center: tuple[float, float], terms: list[str]) -> list[dict]:
    """One query a term at the centre of an area."""
    return [{"q": t, "lon": center[0], "lat": center[1]} for t in terms]


def split_budget(districts: int, budget: int) -> int:
    """Calls for each district: an even share, two at least."""
    return max(2, budget // max(1, districts))
