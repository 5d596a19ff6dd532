"""The country grid: cells inside regions, state of each district, nearest stations, gaps, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions import geo
from skyhive.operators.neighbours import nearest_sites
from skyhive.operators.regions import TILE_DEG, is_inside, tiles
from skyhive.operators.scale import exact_quantiles
from skyhive.session import side_by_side

FILL_PARTS = 64  # our own: shares of tiles in which cells are laid

# Fixed values
PARENT_LEVELS = (4, 5, 6)
GAP_QUANTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
GAP_KM = (10, 25, 50, 100)


def fill(polygons: DataFrame, res: int, label: str) -> DataFrame:
    """Cells whose centroid lies in a polygon, with its name; where polygons overlap the first one wins.

    The lattice is laid tile by tile, so a polygon as large as a country is spread over its tiles. Tiles are dealt out
    before cells are laid: they are few bytes, and adaptive execution would put all of them into one task.
    """
    side = geo.SIDES[res]
    rise, run = F.lit(1.5 * side), F.lit(side * geo.SQRT3)
    to_y = lambda lat: F.lit(geo.EARTH_RADIUS_KM / geo.C0) * F.sin(F.radians(lat))
    to_x = lambda lon: F.lit(geo.EARTH_RADIUS_KM * geo.C0) * F.radians(lon)
    south = F.greatest(F.lit(-90.0), F.col("ty") * F.lit(TILE_DEG))
    north = F.least(F.lit(90.0), (F.col("ty") + 1) * F.lit(TILE_DEG))
    west, east = F.col("tx") * F.lit(TILE_DEG), (F.col("tx") + 1) * F.lit(TILE_DEG)
    rows = F.sequence(F.floor(to_y(south) / rise), F.ceil(to_y(north) / rise))
    cols = F.sequence(F.floor(to_x(west) / run - F.col("r") / 2.0), F.ceil(to_x(east) / run - F.col("r") / 2.0))
    lattice = (tiles(polygons, 0.0).repartition(FILL_PARTS, "tx", "ty", "ord").withColumn("r", F.explode(rows)).withColumn("q", F.explode(cols))
               .withColumn("lat", geo.lattice_lat(F.lit(side), F.col("r")))
               .withColumn("lon", geo.lattice_lon(F.lit(side), F.col("q"), F.col("r")))
               .where((F.floor(F.col("lat") / TILE_DEG) == F.col("ty"))
                      & (F.floor(F.col("lon") / TILE_DEG) == F.col("tx"))))
    inside = lattice.where(is_inside(F.col("lon"), F.col("lat"), F.col("sides")))
    return (inside.groupBy(geo.pack(F.lit(res), F.col("q"), F.col("r")).alias("cell"))
            .agg(F.min_by("name", "ord").alias(label)))


def district_states(state_cells: DataFrame, district_cells: DataFrame) -> DataFrame:
    """Each district's state: the state most of its cells fall in."""
    votes = (district_cells.join(state_cells, "cell").groupBy("district", "state")
             .agg(F.count(F.lit(1)).alias("votes"), F.min("cell").alias("first_cell")))
    return votes.groupBy("district").agg(
        F.max_by("state", F.struct("votes", -F.col("first_cell"))).alias("state"))


def build(states: DataFrame, districts: DataFrame, res: int) -> DataFrame:
    """cell, lat, lon, district, state and coarser parents. District slivers take their district's state."""
    state_cells, district_cells = fill(states, res, "state"), fill(districts, res, "district")
    majority = district_states(state_cells, district_cells).withColumnRenamed("state", "majority")
    cells = (state_cells.join(district_cells, "cell", "full").join(majority, "district", "left")
             .withColumn("state", F.coalesce("state", "majority")).where("state IS NOT NULL"))
    parents = [geo.parent("cell", p, res).alias(f"cell_r{p}") for p in PARENT_LEVELS if p < res]
    return cells.select("cell", geo.centroid_lat("cell", res).alias("lat"), geo.centroid_lon("cell", res).alias("lon"),
                        "district", "state", *parents)


def fixed_decimals(value: Column, digits: int = 5) -> Column:
    return F.format_string(f"%.{digits}f", value)


def wkt(cell, res: int | None = None) -> Column:
    """Closed polygon text of a cell, longitude first, five decimals."""
    ring = geo.boundary(cell, res)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    points = F.transform(closed, lambda p: F.concat(fixed_decimals(p["lon"]), F.lit(" "), fixed_decimals(p["lat"])))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def geojson_feature(cell, properties: Column, res: int | None = None) -> Column:
    """One GeoJSON feature as text, coordinates at four decimals."""
    ring = geo.boundary(cell, res)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    points = F.transform(closed, lambda p: F.array(F.round(p["lon"], 4), F.round(p["lat"], 4)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"),
                              properties.alias("properties")), {"ignoreNullFields": "false"})


def with_stations(grid: DataFrame, stations: DataFrame, res: int) -> DataFrame:
    """Adds station_count, and id and distance of the nearest station, of any and of healthy ones."""
    placed = stations.withColumn("cell", geo.cell_of("lat", "lon", res))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("station_count"))
    spots = grid.select(F.col("cell").alias("target"), "lat", "lon")

    def closest(sites: DataFrame, km: str, site: str) -> DataFrame:
        return (nearest_sites(spots, sites.select(F.col("station_id").alias("site"), "lat", "lon"), 1)
                .select(F.col("target").alias("cell"), F.col("km").alias(km), F.col("site").alias(site)))

    out = grid.join(counts, "cell", "left").withColumn("station_count", F.coalesce("station_count", F.lit(0)))
    searches = [lambda: closest(placed, "dist_km", "nearest_station_id")]
    if "health" in stations.columns:
        healthy = placed.where("health = 'healthy'")
        searches.append(lambda: closest(healthy, "dist_working_km", "nearest_working_station_id"))
    for found in side_by_side(grid.sparkSession, *searches):
        out = out.join(found, "cell", "left")
    return out


def gap_quantiles(grid: DataFrame, column: str) -> DataFrame:
    shares = [F.round(100 * F.avg((F.col(column) > km).cast("double")), 6).alias(f"over_{km}_pct") for km in GAP_KM]
    spread = exact_quantiles(grid, [], column, GAP_QUANTILES)
    both = spread.select(F.struct(*GAP_QUANTILES).alias("q"))
    return grid.agg(*shares).withColumn("q", both.scalar()).select(
        *[F.round(F.col(f"q.{n}"), 6).alias(n) for n in GAP_QUANTILES],
        *[f"over_{km}_pct" for km in GAP_KM])


def gaps_by_state(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """Per state: cells, median distances, share beyond 50 km, stations and healthy stations (0 if none)."""
    base = grid.where("state IS NOT NULL")
    medians = exact_quantiles(base, ["state"], "dist_km", {"median_km": 0.5}).drop("n")
    working = exact_quantiles(base, ["state"], "dist_working_km", {"median_working_km": 0.5}).drop("n")
    cells = base.groupBy("state").agg(
        F.count(F.lit(1)).alias("cells"),
        (100 * F.avg((F.col("dist_km") > 50).cast("double"))).alias("pct_over_50km"))
    sites = stations.groupBy("state").agg(
        F.count(F.lit(1)).alias("stations"), F.sum((F.col("health") == "healthy").cast("bigint")).alias("healthy"))
    return (cells.join(medians, "state", "left").join(working, "state", "left").join(sites, "state", "left")
            .fillna(0, ["stations", "healthy"]))


def grid_overview(grid: DataFrame, res: int) -> DataFrame:
    area = geo.cell_area_km2(res)
    share = F.avg((F.col("station_count") > 0).cast("double"))
    return grid.agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.count(F.lit(1)) * area, 3).alias("area_km2"),
        F.sum(F.col("district").isNull().cast("bigint")).alias("no_district"),
        F.sum((F.col("station_count") > 0).cast("bigint")).alias("cells_with_station"),
        F.round(100 * share, 6).alias("station_cells_pct"))


def outside_grid(stations: DataFrame, grid: DataFrame, res: int) -> DataFrame:
    return stations.withColumn("cell", geo.cell_of("lat", "lon", res)).join(grid.select("cell"), "cell", "left_anti")
