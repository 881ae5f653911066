"""Resolution of one place across sources: blocked candidate pairs, one-to-one matching, enrichment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.functions.fuzzy import best_set_ratio
from placewright.functions.geo import cell, haversine_m, reach
from placewright.functions.text import has_arabic, match_variants, normalized
from placewright.operators.lineage import cut
from placewright.operators.quality import repair
from placewright.operators.rank import refresh_derived

MATCH_M, SAME_SCRIPT, CROSS_SCRIPT = 150.0, 72.0, 84.0
GEOCODE_M, GEOCODE_SCORE = 200.0, 70.0
RATING_M, RATING_SCORE = 150.0, 72.0
# Tags that make an object a place, and tags that are kept.
POI_TAGS = ["amenity", "shop", "tourism", "office", "leisure", "healthcare", "craft"]
WANTED_TAGS = ["name", "name:ar", "name:en", "opening_hours", "wikidata", "wikipedia", "phone", "contact:phone", "website", "contact:website", "brand", "brand:wikidata", "cuisine", "amenity", "shop", "tourism", "office", "leisure", "healthcare", "craft", "highway"]


def tag(name: str, *others: str) -> Column:
    """First non-empty of the named tags."""
    return F.coalesce(*[F.nullif(F.try_element_at(F.col("tags"), F.lit(n)), F.lit("")) for n in (name, *others)])


def is_poi() -> Column:
    return tag("highway").isNull() & F.coalesce(*[tag(t) for t in POI_TAGS]).isNotNull()


def wanted(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(WANTED_TAGS))


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """All (left, right) within the radius, by equi-join on grid cells: the right side goes to each neighbouring cell.

    ``left`` has l_lon, l_lat; ``right`` has r_lon, r_lat. A row's own latitude sets how many cells the radius spans.
    """
    span = lambda k: F.sequence(-k, k)
    wide, high = span(reach(F.col("r_lat"), radius_m)), span(reach(F.lit(0.0), radius_m))
    at = left.withColumns({"cx": cell(F.col("l_lon")), "cy": cell(F.col("l_lat"))})
    around = right.withColumn("cx", F.explode(F.transform(wide, lambda d: cell(F.col("r_lon")) + d))).withColumn("cy", F.explode(F.transform(high, lambda d: cell(F.col("r_lat")) + d)))
    met = at.join(around, ["cx", "cy"]).drop("cx", "cy")
    return met.withColumn("dist", haversine_m(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat"))).where(F.col("dist") <= radius_m)


def _names(*cols: Column) -> Column:
    return match_variants(*cols)


def _sides(places: DataFrame, pois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right): keys of the places and objects that have names, and all that their pairs are judged by."""
    left = places.select("id", F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"), _names(F.col("name_primary"), F.col("name_ar"), F.col("name_en")).alias("l_names"), F.coalesce(has_arabic(F.col("name_primary")), F.lit(False)).alias("l_ar"))
    own = pois.where(is_poi())
    right = own.select("osm_type", "osm_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), _names(tag("name"), tag("name:ar"), tag("name:en")).alias("r_names"), F.coalesce(has_arabic(tag("name")), F.lit(False)).alias("r_ar"))
    return left.where(F.size("l_names") > 0), right.where(F.size("r_names") > 0)


def _alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs near enough and alike enough, with similarity and dist; a higher bar where scripts differ."""
    pairs = near_pairs(left, right, MATCH_M).withColumn("similarity", best_set_ratio(F.col("l_names"), F.col("r_names")))
    bar = F.when(F.col("l_ar") == F.col("r_ar"), SAME_SCRIPT).otherwise(CROSS_SCRIPT)
    return pairs.where(F.col("similarity") >= bar)


def candidate_pairs(places: DataFrame, pois: DataFrame) -> DataFrame:
    """id, osm_type, osm_id, similarity, dist of pairs near enough and alike enough."""
    return _alike(*_sides(places, pois)).select("id", "osm_type", "osm_id", "similarity", "dist")


def _tied(ranked: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pairs that groups of full ties give in one round: where every left of a group is tied with every right and neither has an
    equal or better pair elsewhere, the greedy order takes them by rank. Hashes only propose groups; counts prove them."""
    best = ranked.where("_l = 1 AND _r = 1").dropDuplicates([*left, *right])
    for side, other, own, open_ in ((left, right, "_gl", "_nl"), (right, left, "_gr", "_nr")):
        whole = W.partitionBy(*side)
        best = best.withColumns({own: F.bit_xor(F.xxhash64(*other)).over(whole), f"{own}_n": F.count("*").over(whole)}).withColumn(f"{own}_shut", F.col(f"{own}_n") == F.col(open_))

    def nodes(side: list[str], own: str, k: str) -> DataFrame:
        n = best.groupBy("_gl", "_gr", *side).agg(F.count("*").alias("c"), F.bool_and(f"{own}_shut").alias("shut"), F.max(f"{own}_n").alias("n"))
        return n.select("_gl", "_gr", *side, "c", (F.col("shut") & (F.col("c") == F.col("n"))).alias("ok"), F.row_number().over(W.partitionBy("_gl", "_gr").orderBy(*side)).alias(k))

    ls, rs = nodes(left, "_gl", "_k"), nodes(right, "_gr", "_k")
    of = lambda n, k: n.groupBy("_gl", "_gr").agg(F.count("*").alias(k), F.sum("c").alias(f"{k}_pairs"), F.bool_and("ok").alias(f"{k}_ok"))
    whole = of(ls, "a").join(of(rs, "b"), ["_gl", "_gr"]).where("a_ok AND b_ok AND a_pairs = a * b").select("_gl", "_gr")
    return ls.join(whole, ["_gl", "_gr"]).select("_gl", "_gr", "_k", *left).join(rs.select("_gl", "_gr", "_k", *right), ["_gl", "_gr", "_k"]).select(*left, *right)


def one_to_one(pairs: DataFrame, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """Greedy matching under the strict total order of ``order``, then the left and right keys, by rounds: pairs first on both
    sides are taken, and groups tied in ``order`` by rank (see ``_tied``); their rows leave.

    Equal to taking pairs in the whole order one by one; it ends when no pair is left, and every round takes one at least. Each
    round's rest is written.
    """
    taken, rest, rounds = None, pairs, 0
    rest = cut(rest)
    while not rest.isEmpty():
        ranked = rest
        for side, rank, n, first in ((left, "_l", "_nl", "_fl"), (right, "_r", "_nr", "_fr")):
            own = W.partitionBy(*side)
            ranked = ranked.withColumns({rank: F.rank().over(own.orderBy(*order)), first: F.row_number().over(own.orderBy(*order, *left, *right))}).withColumn(n, F.count_if(F.col(rank) == 1).over(own))
        ranked = cut(ranked.where("_l = 1 AND _r = 1"))
        tied = _tied(ranked, left, right).withColumn("_tied", F.lit(True))
        best = ranked.dropDuplicates([*left, *right]).join(tied, [*left, *right], "left").where("_tied OR _fl = 1 AND _fr = 1")
        best = cut(best.select(*pairs.columns))
        taken, rounds = best if taken is None else taken.unionByName(best), rounds + 1
        if rounds % 20 == 0:
            taken = cut(taken)
        rest = cut(rest.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti"))
    return rest if taken is None else taken


def _kinds(side: DataFrame, keys: list[str], kind: str, n: str) -> tuple[DataFrame, DataFrame]:
    """(members, kinds): keys whose rows are alike in all other columns are one kind, named by a number. A member has its rank
    ``at`` in the order of the keys, a kind its number of members ``n`` and a row for each row that one of its keys has."""
    rows = side.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*[c for c in side.columns if c not in keys]))).alias("rows"))
    rows, own = cut(rows.withColumn("_i", F.monotonically_increasing_id())), W.partitionBy("rows")
    members = cut(rows.withColumns({kind: F.min("_i").over(own), n: F.count("*").over(own), "at": F.row_number().over(own.orderBy(*keys))}))
    return members.select(kind, "at", *keys), members.where("at = 1").select(kind, n, F.explode("rows").alias("_row")).select(kind, n, "_row.*")


def _connected(pairs: DataFrame) -> DataFrame:
    """``pairs`` of kinds l, r with the least l of all they are connected with, as ``label``."""
    now, loose = pairs.withColumn("label", F.col("l")), True
    while loose:
        for by in ("r", "l", "r", "l"):
            now = now.withColumn("label", F.min("label").over(W.partitionBy(by)))
        now = cut(now.withColumn("_loose", F.max("label").over(W.partitionBy("r")) > F.min("label").over(W.partitionBy("r"))))
        loose, now = not now.where("_loose").isEmpty(), now.drop("_loose")
    return now


def _settle(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """Connected kinds of equal rank: lefts in the order of their keys each take the first right left of the kinds they are paired with."""
    reach: dict[int, list[int]] = {}
    for x, y in zip(pairs.column("l").to_pylist(), pairs.column("r").to_pylist()):
        reach.setdefault(x, []).append(y)
    lefts, queues = [], {}
    for left, kind, at, nth in sorted(zip(*(members.column(c).to_pylist() for c in ("left", "kind", "at", "nth"))), key=lambda m: -m[3]):
        lefts.append((nth, kind, at)) if left else queues.setdefault(kind, []).append((nth, at))  # the first is last, for pop
    out = []
    for _, kind, at in reversed(lefts):
        reach[kind] = [y for y in reach[kind] if queues[y]]
        if reach[kind]:
            first = min(reach[kind], key=lambda y: queues[y][-1])
            out.append((kind, first, at - 1, queues[first].pop()[1] - 1))
    l, r, ul, ur = zip(*out)
    n = len(out)
    return pa.table([pa.array(l, pa.int64()), pa.array(r, pa.int64()), *[pa.array([pairs.column(c)[0].as_py()] * n, pa.float64()) for c in ("worse", "dist")], pa.array(ul, pa.int64()), pa.array(ur, pa.int64()), pa.array([1] * n, pa.int64())], ["l", "r", "worse", "dist", "ul", "ur", "k"])


def _match_kinds(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """l, r, worse, dist, ul, ur, k: the k members of l after its first ul go to the k of r after its first ur, in order.

    ``pairs``: l, r, worse, dist, nl, nr, once each. A kind's members are taken in the order of their keys, so what is left of it is
    a number. Each round takes pairs of kinds that are first on both sides: alone where neither has an equal one, else by
    ``_settle`` together with all they are connected with, once every one of these is first on both sides.
    """
    taken, rounds = None, 0
    rest = cut(pairs.withColumns({"ul": F.lit(0).cast("long"), "ur": F.lit(0).cast("long")}))
    while taken is None or not rest.isEmpty():
        best = rest
        for by, rank, n in (("l", "_l", "_nl"), ("r", "_r", "_nr")):
            best = best.withColumn(rank, F.rank().over(W.partitionBy(by).orderBy("worse", "dist"))).withColumn(n, F.count_if(F.col(rank) == 1).over(W.partitionBy(by)))
        best = best.where("_l = 1 AND _r = 1")
        best = cut(best.withColumn("_shut", (F.count("*").over(W.partitionBy("l")) == F.col("_nl")) & (F.count("*").over(W.partitionBy("r")) == F.col("_nr"))))
        now = best.where("_nl = 1 AND _nr = 1").select("l", "r", "worse", "dist", "ul", "ur", F.least("nl", "nr").alias("k"))
        tied = best.where("_nl > 1 OR _nr > 1")
        if not tied.isEmpty():
            tied = _connected(tied)
            tied = cut(tied.join(tied.groupBy("label").agg(F.bool_and("_shut").alias("_all")).where("_all"), "label"))
            of = lambda kinds, by, used, keys: kinds.join(tied.select("label", by, used).distinct(), by).where(F.col("at") > F.col(used)).select(F.col("label").alias("of"), F.lit(by == "l").alias("left"), F.col(by).alias("kind"), "at", F.row_number().over(W.partitionBy("label").orderBy(*keys)).alias("nth"))
            both = of(lefts, "l", "ul", left).unionByName(of(rights, "r", "ur", right))
            now = now.unionByName(tied.select("label", "l", "r", "worse", "dist").groupBy("label").cogroup(both.groupBy("of")).applyInArrow(_settle, now.schema))
        now = cut(now)
        taken, rounds = now if taken is None else taken.unionByName(now), rounds + 1
        if rounds % 20 == 0:
            taken = cut(taken)
        for by, used, n in (("l", "ul", "nl"), ("r", "ur", "nr")):
            rest = rest.join(now.groupBy(by).agg(F.sum("k").alias("_k")), by, "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
            rest = rest.withColumns({used: F.col(used) + F.col("_k"), n: F.col(n) - F.col("_k")}).where(F.col(n) > 0).drop("_k")
        rest = cut(rest)
    return taken


def conflate(places: DataFrame, pois: DataFrame) -> DataFrame:
    """id, osm_type, osm_id, similarity, dist: ``candidate_pairs`` taken one to one in the order of similarity, then dist, id and the
    object's key. Places alike in position and names, and objects alike, are paired and matched as kinds, so none costs its square."""
    left, right = ["id"], ["osm_type", "osm_id"]
    sides = _sides(places, pois)
    (lefts, l_kinds), (rights, r_kinds) = _kinds(sides[0], left, "l", "nl"), _kinds(sides[1], right, "r", "nr")
    pairs = _alike(l_kinds, r_kinds).groupBy("l", "r", "nl", "nr").agg(F.min(F.struct((-F.col("similarity")).alias("worse"), "dist")).alias("_d"))
    taken = _match_kinds(pairs.select("l", "r", "nl", "nr", "_d.*"), lefts, rights, left, right)
    each = taken.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    each = each.select("l", "r", (F.col("ul") + F.col("_i")).alias("at_l"), (F.col("ur") + F.col("_i")).alias("at_r"), (-F.col("worse")).alias("similarity"), "dist")
    each = each.join(lefts.withColumnRenamed("at", "at_l"), ["l", "at_l"]).join(rights.withColumnRenamed("at", "at_r"), ["r", "at_r"])
    return each.select(*left, *right, "similarity", "dist")


def fill(places: DataFrame, matches: DataFrame, pois: DataFrame, now: Column) -> DataFrame:
    """Matched objects fill gaps; their hours and entity id win; their identity and time are stamped."""
    objects = pois.select("osm_type", "osm_id", tag("name:ar").alias("o_ar"), tag("name:en").alias("o_en"), tag("phone", "contact:phone").alias("o_phone"), tag("website", "contact:website").alias("o_site"), tag("opening_hours").alias("o_hours"), tag("wikidata").alias("o_wd"))
    new = matches.join(objects, ["osm_type", "osm_id"]).select("id", F.col("osm_type").alias("o_type"), F.col("osm_id").alias("o_id"), "o_ar", "o_en", "o_phone", "o_site", "o_hours", "o_wd", F.lit(True).alias("o_hit"))
    df = places.join(new, "id", "left")
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    df = df.withColumns({"name_ar": first("name_ar", "o_ar"), "name_en": first("name_en", "o_en"), "phone": first("phone", "o_phone"), "website": first("website", "o_site"), "opening_hours": first("o_hours", "opening_hours"), "wikidata_id": first("o_wd", "wikidata_id")})
    hit = F.coalesce("o_hit", F.lit(False))
    df = df.withColumns({"osm_type": F.when(hit, F.col("o_type")).otherwise(F.col("osm_type")), "osm_id": F.when(hit, F.col("o_id")).otherwise(F.col("osm_id")), "enriched_at": F.when(hit, now).otherwise(F.col("enriched_at"))})
    return df.drop("o_type", "o_id", "o_ar", "o_en", "o_phone", "o_site", "o_hours", "o_wd", "o_hit")


def attach_entities(places: DataFrame, entities: DataFrame) -> DataFrame:
    """Sitelinks, photo and attribution of the entity (qid, image_url, sitelinks, attribution) a place names."""
    e = entities.select(F.col("qid").alias("wikidata_id"), F.col("sitelinks").alias("_s"), F.col("image_url").alias("_u"), F.col("attribution").alias("_a"), F.lit(True).alias("_hit")).withColumn("_n", F.row_number().over(W.partitionBy("wikidata_id").orderBy(F.desc("_s"), "_u", "_a"))).where("_n = 1").drop("_n")
    df = places.join(e, "wikidata_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    df = df.withColumns({"wikidata_sitelinks": F.when(hit, F.col("_s").cast("int")).otherwise(F.col("wikidata_sitelinks")), "photo_url": F.when(hit, F.col("_u")).otherwise(F.col("photo_url")), "photo_attribution": F.when(hit, F.col("_a")).otherwise(F.col("photo_attribution"))})
    return df.drop("_s", "_u", "_a", "_hit").select(*places.columns)


def enrich(places: DataFrame, pois: DataFrame, now: Column, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(enriched places, report): match, fill, entities, prominence, repair, derived columns.

    Prominence is computed before duplicates are marked, so the survivor is the most prominent place.
    """
    matches = conflate(places, pois)
    df = fill(places, matches, pois, now)
    if entities is not None:
        df = attach_entities(df, entities)
    tags = matches.join(pois, ["osm_type", "osm_id"]).select("id", "tags")
    df = refresh_derived(repair(refresh_derived(df), tags))
    return df, report(places, df, matches)


def report(before: DataFrame, after: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counters of an enrichment."""
    old = before.select("id", *[F.col(c).alias(f"o_{c}") for c in ("name_ar", "name_en", "phone", "website", "opening_hours", "wikidata_id")])
    gain = [F.count_if(F.col(f"o_{c}").isNull() & F.col(c).isNotNull()).alias(f"{c}_added") for c in ("name_ar", "name_en", "phone", "website", "opening_hours", "wikidata_id")]
    counts = after.join(old, "id").agg(F.count("*").alias("places"), *gain, F.count_if(F.col("photo_url").isNotNull()).alias("photos"), F.count_if(~F.col("category_final").eqNullSafe(F.col("category"))).alias("category_changed"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"))
    return counts.crossJoin(matches.agg(F.count("*").alias("matched")))  # one row each


def geocode_match(places: DataFrame, answers: DataFrame) -> DataFrame:
    """id and the best geocoder answer within 200 m of similarity 70 or more, by similarity, then distance."""
    left = places.select("id", F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"), F.array(normalized(F.col("name_primary"))).alias("l_names"))
    details = lambda k: F.try_element_at("namedetails", F.lit(k))
    names = F.filter(F.array_distinct(F.array(*[normalized(c) for c in (F.col("name"), details("name"), details("name:ar"), details("name:en"))])), lambda n: n != "")
    right = answers.select("osm_type", "osm_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), names.alias("r_names"), "importance", F.try_element_at("extratags", F.lit("opening_hours")).alias("opening_hours"), F.try_element_at("extratags", F.lit("wikidata")).alias("wikidata_id"))
    pairs = near_pairs(left, right, GEOCODE_M).withColumn("similarity", best_set_ratio(F.col("l_names"), F.col("r_names"))).where(F.col("similarity") >= GEOCODE_SCORE)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "dist", "osm_type", "osm_id")
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "osm_type", "osm_id", "importance", "opening_hours", "wikidata_id", "similarity", "dist")


