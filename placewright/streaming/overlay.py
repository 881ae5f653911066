"""Extension: the overlay as a stream of landed search rows, each place once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, delay: str = "30 days") -> DataFrame:
    """Rows (place_id, fetched_at, ...) without repeats of a place within the delay."""
    return rows.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["place_id"])


def ratings_by_day(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows and mean rating of each day, closed when its delay has passed."""
    day = F.window("fetched_at", "1 day")
    return rows.withWatermark("fetched_at", delay).groupBy(day.alias("w")).agg(F.count("*").alias("rows"), F.avg("rating").alias("rating")).select(F.col("w.start").alias("day"), "rows", "rating")
