"""Distances, boxes and grid cells as native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DECAY_M = 1500.0
CELL_DEG = 0.002


@dataclass(frozen=True)
class BBox:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self):
        if not (self.min_lon < self.max_lon and self.min_lat < self.max_lat):
            raise ValueError(f"box is empty or inverted: {self}")

    @property
    def center(self) -> tuple[float, float]:
        return (self.min_lon + self.max_lon) / 2, (self.min_lat + self.max_lat) / 2

    def contains(self, lon: Column, lat: Column) -> Column:
        return lon.between(self.min_lon, self.max_lon) & lat.between(self.min_lat, self.max_lat)


# Named boxes (min_lon, min_lat, max_lon, max_lat).
PRESETS = {"olaya": BBox(46.665, 24.700, 46.690, 24.725), "riyadh": BBox(46.50, 24.55, 46.90, 24.90), "jeddah": BBox(39.10, 21.40, 39.30, 21.75), "dammam": BBox(49.95, 26.35, 50.20, 26.50)}
# City boxes (min_lat, min_lon, max_lat, max_lon).
CITY_BOXES = {"jeddah": (21.20, 38.95, 22.05, 39.45), "riyadh": (24.40, 46.35, 25.05, 47.10), "dammam": (26.20, 49.85, 26.65, 50.30), "makkah": (21.25, 39.70, 21.55, 40.00), "madinah": (24.35, 39.45, 24.65, 39.75)}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("double")


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.when(a.isNotNull(), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def near_box(lon, lat, radius_m: float, at_lon: Column, at_lat: Column) -> Column:
    """A box that holds the circle: a predicate that scans can use."""
    dlat = radius_m / 110_000.0
    dlon = F.least(F.lit(180.0), F.lit(dlat) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs(_col(lat)) + dlat)))))
    return at_lat.between(_col(lat) - dlat, _col(lat) + dlat) & at_lon.between(_col(lon) - dlon, _col(lon) + dlon)


def decay(distance: Column, scale: float = DECAY_M) -> Column:
    return F.coalesce(F.exp(-distance / scale), F.lit(0.0))


def cell(x: Column, size: float = CELL_DEG) -> Column:
    """Grid coordinate, truncated toward zero."""
    return (x / size).cast("int")


def reach(lat: Column, radius_m: float, size: float = CELL_DEG) -> Column:
    """Cells to each side that hold the radius at a latitude."""
    edge = F.least(F.lit(89.9), F.abs(lat) + radius_m / 110_000.0)
    return F.greatest(F.lit(1), F.ceil(radius_m / (110_000.0 * F.cos(F.radians(edge))) / size).cast("int"))


def area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    return (max_lon - min_lon) * 101.0 * (max_lat - min_lat) * 111.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
