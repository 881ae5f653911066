"""Category repair and duplicate marking. Repairs go to audit columns; the source category stays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.functions.exprs import first_where, let
from placewright.functions.lexicons import BRAND_CATEGORIES, TAG_CATEGORIES, TAG_KEYS
from placewright.functions.text import normalized

DUPLICATE_M = 120.0


def _with_audit(df: DataFrame) -> DataFrame:
    kinds = {"category_final": "string", "category_source": "string", "category_confidence": "double", "duplicate_of": "string"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def consensus(places: DataFrame) -> DataFrame:
    """norm, winner, strength, members, wrong of each name cluster whose members disagree; ties go to the least name."""
    named = places.where(F.col("name_primary").isNotNull()).select(normalized(F.col("name_primary")).alias("norm"), "category", "confidence")
    votes = named.groupBy("norm", "category").agg(F.count("*").alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0)) + 0.1).alias("weight"))
    has = F.coalesce(F.col("category"), F.lit("")) != ""
    best = F.min_by("category", F.when(has, F.struct((-F.col("weight")).alias("w"), "category")))
    out = votes.groupBy("norm").agg(F.sum("n").alias("members"), F.count(F.when(has, 1)).alias("kinds"), best.alias("winner"), F.max(F.when(has, F.col("weight"))).alias("top"), F.sum(F.when(has, F.col("weight"))).alias("all"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("\x00")), "n"))).alias("by"))
    out = out.where("members >= 2 AND kinds >= 2")
    return out.select("norm", "winner", (F.col("top") / F.col("all")).alias("strength"), "members", (F.col("members") - F.try_element_at("by", F.col("winner"))).alias("wrong"))


def consensus_report(places: DataFrame) -> DataFrame:
    sizes = places.where(F.col("name_primary").isNotNull()).groupBy(normalized(F.col("name_primary")).alias("norm")).count().where("count >= 2").agg(F.count("*").alias("clusters"))
    return sizes.crossJoin(consensus(places).agg(F.count("*").alias("conflicted_clusters"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("category_corrected")))  # one row each


def harmonize(places: DataFrame) -> DataFrame:
    """Clusters in conflict get their weighted majority; rows without a final category keep their own."""
    df = _with_audit(places).withColumn("_norm", F.when(F.col("name_primary").isNotNull(), normalized(F.col("name_primary"))))
    won = consensus(places).select(F.col("norm").alias("_norm"), "winner", "strength")
    df = df.join(won, "_norm", "left")
    fresh = F.col("winner").isNull() & F.col("category_final").isNull()
    pick = lambda won, own, old: F.when(F.col("winner").isNotNull(), won).when(fresh, own).otherwise(F.col(old)).alias(old)
    audit = [pick(F.col("winner"), F.col("category"), "category_final"), pick(F.lit("cluster_consensus"), F.lit("overture"), "category_source"), pick(F.col("strength"), F.lit(1.0), "category_confidence")]
    keep = [c for c in df.columns if c not in ("_norm", "winner", "strength", "category_final", "category_source", "category_confidence")]
    return df.select(*keep, *audit)


def tag_category(tags: Column) -> Column:
    """Category of a map of tags; keys rank in a fixed order."""
    options = []
    for key in TAG_KEYS:
        table = F.create_map(*[F.lit(x) for (k, v), c in TAG_CATEGORIES.items() if k == key for x in (v, c)])
        options.append(F.try_element_at(table, F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))))
    return F.coalesce(*options)


def _override(df: DataFrame, found: Column, source: str, confidence: float) -> DataFrame:
    hit = found.isNotNull()
    return df.withColumns({"category_final": F.when(hit, found).otherwise(F.col("category_final")), "category_source": F.when(hit, source).otherwise(F.col("category_source")), "category_confidence": F.when(hit, confidence).otherwise(F.col("category_confidence"))})


def apply_tags(places: DataFrame, tags: DataFrame) -> DataFrame:
    """Overrides from tags (id, tags) of matched objects."""
    found = tags.select("id", tag_category(F.col("tags")).alias("_found")).where("_found IS NOT NULL").dropDuplicates(["id"])
    return _override(_with_audit(places).join(found, "id", "left"), F.col("_found"), "osm", 0.95).drop("_found")


def brand_category(name: Column) -> Column:
    """Of a normalised name: its brand's category, exact, else that of the first brand it begins with."""
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in BRAND_CATEGORIES.items() for x in kv]), name)
    start = let(name, lambda n: first_where(BRAND_CATEGORIES, lambda k: n.startswith(F.concat(k, F.lit(" ")))))
    return F.coalesce(exact, start)


def apply_brands(places: DataFrame) -> DataFrame:
    """Overrides from the brand lexicon, by brand and then by name."""
    df = _with_audit(places).withColumns({"_b": normalized(F.col("brand_name")), "_n": normalized(F.col("name_primary"))})
    found = F.coalesce(brand_category(F.col("_b")), brand_category(F.col("_n")))
    return _override(df.withColumn("_found", found), F.col("_found"), "brand_lexicon", 0.9).drop("_b", "_n", "_found")


def _leaders(rows: pd.DataFrame) -> pd.DataFrame:
    """Within a cluster, most prominent first: a row within reach of a kept leader is its duplicate, else leads."""
    import numpy as np

    rows = rows.sort_values(["prominence", "id"], ascending=[False, True], na_position="last")
    lon, lat, ids, out = np.radians(rows["lon"].to_numpy()), np.radians(rows["lat"].to_numpy()), rows["id"].to_numpy(), []
    kept: list[int] = []
    for i in range(len(rows)):
        if kept:
            k = np.array(kept)
            a = np.sin((lat[k] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[k]) * np.sin((lon[k] - lon[i]) / 2) ** 2
            near = np.flatnonzero(2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1, a))) <= DUPLICATE_M)
            if len(near):
                out.append((ids[i], ids[k[near[0]]]))
                continue
        kept.append(i)
    return pd.DataFrame(out, columns=["id", "leader"])


def mark_duplicates(places: DataFrame) -> DataFrame:
    """Sets ``duplicate_of`` where a more prominent place of the same name is within 120 m.

    Clusters of a name are first cut at gaps of latitude wider than the radius, which no duplicate crosses, so that one
    frequent name isn't one task's work.
    """
    df = _with_audit(places)
    rows = df.where(F.col("duplicate_of").isNull() & F.col("name_primary").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rows = rows.select("id", normalized(F.col("name_primary")).alias("norm"), "lon", "lat", F.coalesce("prominence", F.lit(0.0)).alias("prominence"))
    by = W.partitionBy("norm").orderBy("lat", "id")
    gap = (F.col("lat") - F.lag("lat").over(by)) * 111_000.0 > 2 * DUPLICATE_M
    rows = rows.withColumn("part", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by))
    many = rows.withColumn("n", F.count("*").over(W.partitionBy("norm", "part"))).where("n >= 2")
    found = many.groupBy("norm", "part").applyInPandas(lambda g: _leaders(g), "id string, leader string")
    return df.join(found, "id", "left").withColumn("duplicate_of", F.coalesce("duplicate_of", "leader")).drop("leader")


def repair(places: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Consensus, tags, brands, duplicates, in that order."""
    df = harmonize(places)
    if tags is not None:
        df = apply_tags(df, tags)
    return mark_duplicates(apply_brands(df))
