"""Daily rasters as tables of pixels: composites and sampling at points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
NODATA = -9999.0
BANDS = ["no2_trop", "aai", "co", "so2", "u10", "v10"]


@dataclass(frozen=True)
class Header:
    west: float
    north: float
    pixel_deg: float
    width: int
    height: int


# The national raster
NATIONAL = Header(68.0, 38.0, 0.05, 600, 640)


def valid(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.when((column > NODATA + 1) & ~F.isnan(column), column)


def pixel_table(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """No-data marks become NULL."""
    others = [c for c in pixels.columns if c not in bands]
    return pixels.select(*others, *[valid(b).alias(b) for b in bands])


def composite(scenes: DataFrame, bands: list[str], final: Column, filled: list[str] | None = None) -> DataFrame:
    """Daily mean of each pixel over its overpasses; where the final product is masked, the early one fills in."""
    filled = bands if filled is None else filled
    clean = pixel_table(scenes, bands)
    mean = {b: F.avg(F.when(final, F.col(b))) for b in bands}
    spare = {b: F.avg(F.when(~final, F.col(b))) for b in filled}
    return clean.groupBy("date", "row", "col").agg(
        *[(F.coalesce(mean[b], spare[b]) if b in spare else mean[b]).alias(b) for b in bands])


def pixel_of(lat, lon, header: Header) -> tuple[Column, Column]:
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    return (F.floor((F.lit(header.north) - lat) / F.lit(header.pixel_deg)).cast("int"),
            F.floor((lon - F.lit(header.west)) / F.lit(header.pixel_deg)).cast("int"))


def sample(points: DataFrame, pixels: DataFrame, header: Header, bands: list[str],
           days: DataFrame | None = None) -> DataFrame:
    """Nearest pixel of each day at each point; points off the raster keep NULLs.

    `days` (one column, date) lists the days each point must have; by default the days that have pixels.
    """
    row, col = pixel_of("lat", "lon", header)
    inside = (row >= 0) & (row < header.height) & (col >= 0) & (col < header.width)
    placed = points.withColumn("row", F.when(inside, row)).withColumn("col", F.when(inside, col))
    days = pixels.select("date").distinct() if days is None else days
    calendar = days.agg(F.array_sort(F.collect_set("date")).alias("all")).scalar()  # one entry per day
    wanted = placed.withColumn("date", F.explode(calendar))
    return (wanted.join(pixels.select("date", "row", "col", *bands), ["date", "row", "col"], "left")
            .drop("row", "col"))
