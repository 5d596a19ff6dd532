"""Rollups to coarser cells, box queries with automatic resolution, and their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions.geo import within_box

# Fixed values of the grid service
MAX_CELLS = 60_000
MIN_RES = 4


def rollup_grid(grid: DataFrame, parent_column: str) -> DataFrame:
    """Mean and least distances, summed stations, and the commonest state (smallest name on a tie)."""
    votes = (grid.where("state IS NOT NULL").groupBy(parent_column, "state").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(parent_column).agg(F.min_by("state", F.struct(-F.col("n"), "state")).alias("state")))
    sums = grid.groupBy(parent_column).agg(
        F.avg("dist_working_km").alias("dist_working_km"), F.avg("dist_km").alias("dist_km"),
        F.min("dist_km").alias("dist_km_min"), F.sum("station_count").cast("bigint").alias("station_count"))
    return sums.join(votes, parent_column, "left").withColumnRenamed(parent_column, "cell")


def rollup_predictions(predicted: DataFrame, parent_column: str) -> DataFrame:
    """Mean value, error and distance; the worst confidence of the members."""
    return predicted.groupBy("date", F.col(parent_column).alias("cell")).agg(
        F.avg("pm25").alias("pm25"), F.avg("uncertainty").alias("uncertainty"),
        F.avg("dist_nearest_km").alias("dist_km"), F.max("confidence").alias("confidence"))


def auto_resolution(count: Column, grid_res: int, max_cells: int = MAX_CELLS) -> Column:
    """The finest resolution that stays under the limit; each coarser level has about a seventh of the cells."""
    steps = F.when(count > max_cells, F.ceil(F.log(count / F.lit(float(max_cells))) / F.log(F.lit(7.0)))).otherwise(0)
    return F.greatest(F.lit(MIN_RES), F.lit(grid_res) - steps.cast("int"))


def box_query(grid: DataFrame, box: tuple[float, float, float, float], grid_res: int, res: int | None = None,
              max_cells: int = MAX_CELLS) -> DataFrame:
    """Cells with their centre in the box, rolled up to the asked or automatic resolution.

    The resolution is chosen inside the same plan by a scalar count. `too_many` marks an answer that exceeds
    seven times the limit, which the caller has to refuse.
    """
    inside = grid.where(within_box("lat", "lon", *box))
    if res is not None and not MIN_RES <= res <= grid_res:
        raise ValueError(f"resolution must lie between {MIN_RES} and {grid_res}")
    if res is None:
        total = inside.agg(F.count(F.lit(1)).alias("n")).scalar()
        chosen = auto_resolution(total, grid_res, max_cells)
    else:
        chosen = F.lit(res)
    levelled = inside.withColumn("res", chosen)
    id_at = F.col("cell")
    for level in range(MIN_RES, grid_res):
        id_at = F.when(F.col("res") == level, F.col(f"cell_r{level}")).otherwise(id_at)
    out = levelled.groupBy("res", id_at.alias("cell")).agg(
        F.avg("dist_working_km").alias("dist_working_km"), F.avg("dist_km").alias("dist_km"),
        F.sum("station_count").cast("bigint").alias("station_count"))
    size = out.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.withColumn("too_many", size > 7 * max_cells)


def columnar(df: DataFrame, keys: list[str], columns: dict[str, int | None], id_column: str = "cell") -> DataFrame:
    """One JSON text per key with parallel arrays sorted by cell; numbers rounded as given.

    For coarse levels, whose number of cells is bounded (about 1,900 at level 4 for the whole country).
    Finer levels are written as row JSON instead.
    """
    entry = F.struct(F.col(id_column).alias("_id"), *[
        (F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c, digits in columns.items()])
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    field = lambda name: lambda e: e[name]
    # ids beyond 2**53 lose digits in JSON numbers, so they travel as hexadecimal text
    body = F.struct(*keys, F.size("_e").alias("count"),
                    F.transform("_e", lambda e: F.lower(F.hex(e["_id"]))).alias("cell"),
                    *[F.transform("_e", field(c)).alias(c) for c in columns])
    return packed.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def stations_in_box(stations: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    return stations if box is None else stations.where(within_box("lat", "lon", *box))


def station_list(stations: DataFrame) -> DataFrame:
    """One null-safe JSON text per station, positions at five decimals, times as text."""
    fields = [c for c in ("station_id", "station_name", "lat", "lon", "city", "state", "rows", "last_seen", "health",
                          "health_reason", "usable_coverage") if c in stations.columns]
    shown = {"lat": F.round("lat", 5), "lon": F.round("lon", 5),
             "last_seen": F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"),
             "usable_coverage": F.round("usable_coverage", 3) if "usable_coverage" in fields else None}
    body = F.struct(*[(shown[f] if f in shown else F.col(f)).alias(f) for f in fields])
    return stations.select("station_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def explanation_at(explained: DataFrame, asked: DataFrame) -> DataFrame:
    """Which explained cell a clicked cell of any loaded resolution stands for, the first one listed if several.

    explained: ord, cell, cell_r5, cell_r4, role. asked: clicked.
    """
    levels = explained.select("ord", "cell", "role", F.explode(
        F.array_distinct(F.array("cell", "cell_r5", "cell_r4"))).alias("clicked"))
    first = levels.groupBy("clicked").agg(F.min(F.struct("ord", "cell", "role")).alias("e"))
    return asked.join(first, "clicked", "left").select(*asked.columns, F.col("e.cell").alias("explained"), "e.role")
