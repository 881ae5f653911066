"""Command line: build, leads, districts, sweep, over landed inputs.

Inputs are Parquet and JSON that other tools have fetched; nothing here calls the network. A corpus is a Parquet folder.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions.geo import PRESETS, BBox
from placewright.operators import conflate, corpus, districts, index, leads, overlay, quality, rank
from placewright.sources import landed, sinks


def _area(p: argparse.ArgumentParser) -> None:
    p.add_argument("preset", nargs="?", choices=sorted(PRESETS))
    p.add_argument("--district")
    p.add_argument("--catalog", help="district catalogue (JSON)")
    p.add_argument("--bbox", nargs=4, type=float, metavar=("MIN_LON", "MIN_LAT", "MAX_LON", "MAX_LAT"))


def area_of(spark: SparkSession, a: argparse.Namespace) -> BBox | None:
    if a.bbox:
        return BBox(*a.bbox)
    if a.district:
        found = districts.find(landed.catalog(spark, a.catalog), a.district).collect()
        if not found:
            sys.exit(f"no district like {a.district}")
        return BBox(*[found[0][c] for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    return PRESETS[a.preset] if a.preset else None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="placewright", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="ingest, enrich, repair and index an area")
    _area(build)
    build.add_argument("--bulk", required=True)
    build.add_argument("--objects", help="landed map objects (JSON)")
    build.add_argument("--entities")
    build.add_argument("--skip-enrich", action="store_true")
    build.add_argument("--all-districts", action="store_true", help="stamp every place with its district")
    build.add_argument("--db", required=True)
    lead = sub.add_parser("leads", help="rank businesses without a website")
    _area(lead)
    lead.add_argument("--db", required=True)
    lead.add_argument("--category", action="append")
    lead.add_argument("--locality")
    lead.add_argument("--min-score", type=float, default=0.35)
    lead.add_argument("--limit", type=int, default=100)
    lead.add_argument("--csv")
    lead.add_argument("--enrich", help="landed search pages (JSON lines) to overlay first")
    lead.add_argument("--max-calls", type=int, default=12)
    dist = sub.add_parser("districts", help="search, status and ranking of districts")
    dist.add_argument("--catalog")
    dist.add_argument("--db")
    dist.add_argument("--refresh", nargs=2, metavar=("CITY", "RAW"), help="derive a catalogue from landed objects")
    dist.add_argument("--search")
    dist.add_argument("--status", action="store_true")
    dist.add_argument("--rank", action="store_true")
    dist.add_argument("--min-score", type=float, default=0.5)
    dist.add_argument("--limit", type=int, default=200)
    swp = sub.add_parser("sweep", help="fold landed search pages into a corpus")
    swp.add_argument("--db", required=True)
    swp.add_argument("--pages", required=True)
    swp.add_argument("--district", required=True)
    swp.add_argument("--budget", type=int, default=20)
    swp.add_argument("--pages-per-term", type=int, default=2)
    return top


def build(spark: SparkSession, a: argparse.Namespace, now) -> DataFrame:
    box = area_of(spark, a)
    if box is None:
        sys.exit("build needs an area")
    places = rank.recompute(corpus.ingest(landed.bulk(spark, a.bulk, box), box))
    if a.catalog and a.all_districts:
        places = districts.stamp(places, landed.catalog(spark, a.catalog))
    elif a.district:
        places = districts.stamp_box(places, a.district, box)
    if a.objects and not a.skip_enrich:
        entities = landed.entities(spark, a.entities).withColumn("attribution", F.lit(None).cast("string")) if a.entities else None
        places, _ = conflate.enrich(places, landed.map_objects(spark, a.objects), now, entities)
    places = rank.refresh_derived(quality.repair(places))
    places.write.mode("overwrite").parquet(f"{a.db}/places")
    places = spark.read.parquet(f"{a.db}/places")
    index.build(places).write(a.db)
    return corpus.coverage(places)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("placewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None))
    if a.command == "build":
        out = build(spark, a, now)
    elif a.command == "leads":
        places, box = spark.read.parquet(f"{a.db}/places"), area_of(spark, a)
        if a.enrich:
            rows = landed.overlay_rows(overlay.first_calls(landed.search_pages(spark, a.enrich), a.max_calls))
            places = overlay.attach_ratings(places, rows, now)
        out = leads.find_leads(places, a.locality, a.category, box, a.min_score, a.limit)
        if a.csv:
            sinks.leads_csv(out, a.csv)
    elif a.command == "districts":
        if a.refresh:
            out = districts.derive_boxes(landed.district_objects(spark, a.refresh[1]), a.refresh[0])
            if a.catalog:
                out.write.mode("overwrite").json(a.catalog)
        elif a.search:
            out = districts.with_area(districts.search(landed.catalog(spark, a.catalog), a.search))
        else:
            places = spark.read.parquet(f"{a.db}/places")
            out = (leads.district_status(places) if a.status else leads.rank_districts(places, a.min_score)).limit(a.limit)
    else:
        pages = landed.search_pages(spark, a.pages)
        kept = overlay.sweep(pages, a.budget, a.pages_per_term)
        places = overlay.upsert_search_rows(spark.read.parquet(f"{a.db}/places"), kept, a.district, now)
        places.write.mode("overwrite").parquet(f"{a.db}/places_next")  # a snapshot of its own: the old one is being read
        out = overlay.sweep_report(pages, a.budget, a.pages_per_term)
    out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
