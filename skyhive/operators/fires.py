"""Fire detections: cleaning, daily sums by cell, and sums within a radius with an upwind weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions import geo
from skyhive.operators.scale import latest
from skyhive.session import cut_lineage

# Fixed values
RADIUS_KM = 150.0
CALM_WIND_MS = 0.5
CALM_WEIGHT = 0.5
FIRE_LEVEL, REGION_LEVEL = 7, 5
STATIC_TYPE = 2
REACH_SLACK = 1 + 1e-9  # our own: more than a square is rounded by


def place_in_time(detections: DataFrame) -> DataFrame:
    """UTC time of the pass, the calendar day in India, and the fine cell."""
    utc = C.pass_time_utc("acq_date", "acq_time")
    return (detections.withColumn("utc", utc).withColumn("date", C.ist_day("utc"))
            .withColumn("cell", geo.cell_of("latitude", "longitude", FIRE_LEVEL)))


def judge_fires(detections: DataFrame, order: list[str], start=None, end=None, keep: list[str] | None = None) -> DataFrame:
    """Detections with `drop_reason`; duplicates collapse to their first row and are counted in `copies`.

    `keep` names the columns wanted beside place, time, source and what the rules read; by default all are carried along.
    """
    placed = detections if "type" in detections.columns else detections.withColumn("type", F.lit(None).cast("int"))
    # used twice, for static cells and for the rows themselves
    carried = None if keep is None else list(dict.fromkeys([*keep, "confidence", "type", "date", "cell"]))
    unique = cut_lineage(latest(place_in_time(placed), ["latitude", "longitude", "utc", "source"], order, carried, last=False), "detections")
    final = F.col("source").endswith("_SP")
    low = F.lower(F.col("confidence")) == "l"
    static = (unique.where(final & ~low & (F.col("type") == STATIC_TYPE))
              .select(F.col("cell")).distinct().withColumn("static_cell", F.lit(True)))
    marked = unique.join(static, "cell", "left")
    outside = F.lit(False)
    if start is not None:
        outside = outside | (F.col("date") < F.lit(start))
    if end is not None:
        outside = outside | (F.col("date") > F.lit(end))
    reason = (F.when(low, F.lit("low_confidence"))
              .when(final & (F.coalesce("type", F.lit(0)) != 0), F.lit("sp_not_vegetation_fire"))
              .when(F.col("source").endswith("_NRT") & F.col("static_cell"), F.lit("nrt_static_source_hex"))
              .when(outside, F.lit("outside_ist_date_range")))
    return marked.withColumn("drop_reason", reason).drop("static_cell")


def kept_fires(judged: DataFrame) -> DataFrame:
    return judged.where("drop_reason IS NULL").drop("drop_reason", "copies")


def fire_drops(judged: DataFrame) -> DataFrame:
    """Counts by reason, with the duplicates that were folded away."""
    copies = judged.agg(F.sum(F.col("copies") - 1).cast("bigint").alias("rows")).select(
        F.lit("duplicate").alias("drop_reason"), "rows")
    faults = (judged.where("drop_reason IS NOT NULL").groupBy("drop_reason")
              .agg(F.count(F.lit(1)).alias("rows")))
    return copies.where("rows > 0").unionByName(faults)


def prefer_source(detections: DataFrame, primary: list[str], fallback: list[str]) -> DataFrame:
    """All days of the primary satellites; the fallback only on days the primary has no detection at all."""
    first = detections.where(F.col("source").isin(primary))
    covered = first.select("acq_date").distinct()
    rest = detections.where(F.col("source").isin(fallback)).join(covered, "acq_date", "left_anti")
    return first.unionByName(rest)


def fires_by_cell(fires: DataFrame) -> DataFrame:
    return fires.groupBy("cell", "date").agg(
        F.count(F.lit(1)).cast("int").alias("fire_count"), F.sum("frp").alias("frp_sum"))


def sources_by_day(fires: DataFrame) -> DataFrame:
    """Which satellites supplied each day, as one sorted text."""
    pairs = fires.select("date", "source").distinct()  # a handful of sources per day
    return pairs.groupBy("date").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def fires_by_month(fires: DataFrame) -> DataFrame:
    return fires.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("fires"))


def fires_by_state(daily: DataFrame, grid: DataFrame, n: int | None = None) -> DataFrame:
    out = (daily.join(grid.select("cell", "state"), "cell", "left").where("state IS NOT NULL")
           .groupBy("state").agg(F.sum("fire_count").cast("bigint").alias("fires"))
           .orderBy(F.desc("fires"), "state"))
    return out.limit(n) if n else out


def fires_outside(daily: DataFrame, grid: DataFrame) -> DataFrame:
    return (daily.join(grid.select("cell"), "cell", "left_anti")
            .agg(F.coalesce(F.sum("fire_count"), F.lit(0)).cast("bigint").alias("outside_grid")))


def fires_by_region(fires: DataFrame, res: int = REGION_LEVEL, parent=geo.parent) -> DataFrame:
    """Count, power and mean position per coarse cell and day: what the radius sums start from."""
    return (fires.groupBy(parent("cell", res, FIRE_LEVEL).alias("region_cell"), "date")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"),
                 F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")))


def upwind_weight(east: Column, north: Column, dist: Column, u, v, speed: Column | None = None) -> Column:
    """Share of the wind that blows from the fire to the target; half in calm air, NULL without wind."""
    u, v = F.col(u), F.col(v)
    speed = F.hypot(u, v) if speed is None else speed
    along = (east * u + north * v) / (F.greatest(dist, F.lit(1e-6)) * F.greatest(speed, F.lit(1e-6)))
    return (F.when(speed.isNull(), None).when(speed < CALM_WIND_MS, F.lit(CALM_WEIGHT))
            .otherwise(F.greatest(F.lit(0.0), along)))


def radius_sums(targets: DataFrame, sources: DataFrame, wind: DataFrame | None = None,
                radius_km: float = RADIUS_KM) -> DataFrame:
    """Fires within a radius of each target cell and day: count and power, plain and upwind-weighted.

    targets: region_cell, lat, lon. sources: date, n, frp, lat, lon. wind: region_cell, date, u10, v10.

    Targets lie on a mesh one radius high; each source is repeated to every mesh square that can hold a
    target in reach at its latitude, so an equi-join finds each pair once. Sources are already one row per
    coarse cell and day, which bounds how many share a square. Wind joins the target-days, not the pairs,
    so that the sums combine before their only shuffle. What a target alone decides (cosine, wind speed) is worked out
    before the join, and a root is drawn only for pairs whose square is in reach: two thirds of the pairs are not.
    """
    step = radius_km / geo.KM_PER_DEGREE_LAT
    mesh = lambda v: F.floor(v / F.lit(step))
    widest = F.least(F.abs(F.col("s_lat")) + step, F.lit(89.9))
    reach = F.lit(radius_km / geo.KM_PER_DEGREE_LON) / F.cos(F.radians(widest))
    spread = (sources.select("date", "n", "frp", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
              .withColumn("mesh_row", F.explode(F.sequence(mesh(F.col("s_lat")) - 1, mesh(F.col("s_lat")) + 1)))
              .withColumn("mesh_col", F.explode(F.sequence(
                  mesh(F.col("s_lon") - reach), mesh(F.col("s_lon") + reach)))))
    meshed = (targets.select("region_cell", "lat", "lon")
              .withColumn("mesh_row", mesh(F.col("lat"))).withColumn("mesh_col", mesh(F.col("lon")))
              .withColumn("cos_lat", F.cos(F.radians("lat"))))
    keys = ["mesh_row", "mesh_col"]
    # as geo.planar_offset_km, with its cosine from before the join
    east = (F.col("lon") - F.col("s_lon")) * F.lit(geo.KM_PER_DEGREE_LON) * F.col("cos_lat")
    north = (F.col("lat") - F.col("s_lat")) * F.lit(geo.KM_PER_DEGREE_LAT)
    if wind is None:
        weight = F.lit(None).cast("double")
    else:
        days = sources.agg(F.collect_set("date").alias("d")).scalar()  # one entry per calendar day
        meshed = (meshed.withColumn("date", F.explode(days))
                  .join(wind.select("region_cell", "date", "u10", "v10", F.hypot("u10", "v10").alias("speed")), ["region_cell", "date"], "left"))
        keys = ["date", *keys]
        weight = upwind_weight(F.col("east"), F.col("north"), F.col("dist"), "u10", "v10", F.col("speed"))
    pairs = (meshed.join(spread, keys)
             .withColumn("east", east).withColumn("north", north)
             .where(F.col("east") * F.col("east") + F.col("north") * F.col("north") <= radius_km * radius_km * REACH_SLACK)
             .withColumn("dist", F.hypot("east", "north")).where(F.col("dist") <= radius_km))
    return (pairs.withColumn("w", weight).groupBy("region_cell", "date")
            .agg(F.sum("n").cast("double").alias("fires_150km"), F.sum("frp").alias("frp_150km"),
                 F.sum(F.col("n") * F.col("w")).alias("upwind_fires_150km"),
                 F.sum(F.col("frp") * F.col("w")).alias("upwind_frp_150km")))
