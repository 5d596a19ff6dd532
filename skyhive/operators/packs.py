"""Cells worth explaining, their signals in one nested record, and the facts an alert is drafted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions import geo
from skyhive.functions.scales import CONFIDENCE_NAMES, pm25_label
from skyhive.operators.neighbours import near_by_health, nearest_sites

# Fixed values of the selection rule
SEPARATION_KM = 300.0
DARK_KM = 50.0
CENTRES = {"delhi_centre": (28.6315, 77.2167), "coimbatore_centre": (11.0168, 76.9558)}
UNNAMED_DISTRICT = "DATA NOT AVAILABLE"
DISTRICT_MISSING = "district not named in boundary data"
RANKED = ["no2_trop", "aai", "co", "so2", "upwind_fires_150km"]


def select_cells(predicted: DataFrame, res: int, centres: dict[str, tuple[float, float]] | None = None,
                 separation_km: float = SEPARATION_KM) -> DataFrame:
    """Per day: fixed centres, the two worst dark zones, the worst low-confidence cell, all far apart.

    The greedy choice is a short chain of aggregates: each pick is the highest cell that keeps its distance
    from all picks before it. Every round looks at all candidates, so nothing is capped, and a day's cells
    never meet in one task; only the picks (a few per day) travel.
    """
    centres = CENTRES if centres is None else centres
    rows = predicted.select("date", "cell", "lat", "lon", "pm25", "confidence", "dist_working_km", "dist_nearest_km")
    picks = None
    if centres:
        fixed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(role).alias("role"),
                                   geo.cell_of(F.lit(lat), F.lit(lon), res).alias("cell"))
                          for i, (role, (lat, lon)) in enumerate(centres.items())])
        wanted = rows.sparkSession.range(1).select(F.explode(fixed).alias("f")).select("f.*")
        picks = rows.join(F.broadcast(wanted), "cell").select("date", "ord", "role", "cell", "lat", "lon")
    dark = (F.col("dist_working_km") > DARK_KM) & (F.col("dist_nearest_km") > DARK_KM)
    rounds = [("dark_zone", dark), ("dark_zone", dark), ("low_confidence", F.col("confidence") == 2)]
    for number, (role, test) in enumerate(rounds, start=len(centres)):
        able = rows.where(test & F.col("pm25").isNotNull())  # NULL would sort before the highest value
        if picks is not None:
            taken = picks.groupBy("date").agg(F.collect_list(F.struct("lat", "lon")).alias("taken"))
            able = able.join(taken, "date", "left").where(F.forall(
                F.coalesce("taken", F.array().cast("array<struct<lat:double,lon:double>>")),
                lambda p: geo.haversine_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]) >= separation_km))
        best = able.groupBy("date").agg(F.min_by(
            F.struct("cell", "lat", "lon"), F.struct(-F.col("pm25"), "cell")).alias("b"))
        found = best.select("date", F.lit(number).alias("ord"), F.lit(role).alias("role"), "b.cell", "b.lat", "b.lon")
        picks = found if picks is None else picks.unionByName(found)
    return picks


def percentile_among(day_rows: DataFrame, picks: DataFrame, columns: list[str]) -> DataFrame:
    """For each pick, the percent of its day's known values strictly below its own, rounded half to even.

    picks: date, cell, at most a handful per calendar day, so they are the side that is repeated.
    """
    own = day_rows.join(picks.select("date", "cell"), ["date", "cell"], "left_semi").select(
        "date", "cell", *[F.col(c).alias(f"own_{c}") for c in columns])
    below = lambda c: F.sum((F.col(c) < F.col(f"own_{c}")).cast("bigint"))
    share = lambda c: F.bround(100 * F.try_divide(below(c), F.count(c)), 0).cast("int")
    values = day_rows.select("date", *columns)
    return values.join(own, "date").groupBy("date", "cell").agg(
        *[F.when(F.max(f"own_{c}").isNotNull(), share(c)).alias(f"{c}_percentile") for c in columns])


def nearest_monitors(picks: DataFrame, stations: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest stations of each pick as an ordered array of structs."""
    spots = picks.select(F.col("cell").alias("target"), "lat", "lon").distinct()
    near = nearest_sites(spots, stations.select(F.col("station_id").alias("site"), "lat", "lon"), k)
    named = near.join(stations.select(F.col("station_id").alias("site"), "station_name", "health"), "site")
    entry = F.struct(F.col("km").alias("order_km"), "site", F.col("station_name").alias("name"),
                     F.round("km", 1).alias("distance_km"), "health")
    drop_order = lambda e: F.struct(e["name"].alias("name"), e["distance_km"].alias("distance_km"),
                                    e["health"].alias("health"))
    return named.groupBy(F.col("target").alias("cell")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), drop_order).alias("nearest_monitors"))


def district_name(district: str = "district") -> Column:
    name = F.trim(F.col(district))
    return F.when(name.isNull() | (name == "") | (F.upper(name) == UNNAMED_DISTRICT), F.lit(DISTRICT_MISSING)).otherwise(
        F.col(district))


def signal_packs(predicted: DataFrame, picks: DataFrame, grid: DataFrame, stations: DataFrame,
                 levels: DataFrame) -> DataFrame:
    """One row per picked cell and day: date, role, cell and the struct `signals`."""
    chosen = picks.select("date", "ord", "role", "cell")
    rows = predicted.join(chosen, ["date", "cell"])
    ranks = percentile_among(predicted, picks, RANKED)
    spots = picks.select(F.col("cell").alias("target"), "lat", "lon").distinct()
    health = near_by_health(spots, stations, DARK_KM).withColumnRenamed("target", "cell")
    errors = levels.select(F.col("level").alias("confidence"), F.col("rel_error_pct").alias("typical_error"))
    joined = (rows.drop("rel_error_pct").join(ranks, ["date", "cell"], "left")
              .join(health, "cell", "left").join(nearest_monitors(picks, stations), "cell", "left")
              .join(grid.select("cell", "district", "state"), "cell", "left").join(errors, "confidence", "left"))
    t = C.tidy
    signals = F.struct(
        F.col("date").cast("string").alias("date"),
        F.struct(F.lower(F.hex("cell")).alias("cell"), district_name().alias("district"), F.col("state")).alias("location"),
        t("pm25", 1).alias("predicted_pm25_ug_m3"), pm25_label("pm25").alias("predicted_category"),
        F.element_at(F.array(*[F.lit(n) for n in CONFIDENCE_NAMES]), F.col("confidence") + 1).alias("model_confidence"),
        F.col("typical_error").alias("prediction_typical_error_pct"),
        t("dist_nearest_km", 1).alias("distance_to_nearest_reporting_monitor_km"),
        t("dist_working_km", 1).alias("distance_to_nearest_working_monitor_km"),
        t("no2_trop", 7).alias("no2_tropospheric_column_mol_m2"),
        F.col("no2_trop_percentile").alias("no2_national_percentile_today"),
        t("aai", 2).alias("aerosol_index"), F.col("aai_percentile").alias("aerosol_index_national_percentile_today"),
        t("co", 5).alias("co_column_mol_m2"), F.col("co_percentile").alias("co_national_percentile_today"),
        t("so2", 6).alias("so2_column_mol_m2"), F.col("so2_percentile").alias("so2_national_percentile_today"),
        F.col("fire_count").cast("int").alias("fires_in_this_hex"),
        t("fires_150km", 0).alias("fires_within_150km"), t("upwind_fires_150km", 1).alias("upwind_fires_within_150km"),
        t("upwind_frp_150km", 1).alias("upwind_fire_radiative_power_mw"),
        F.col("upwind_fires_150km_percentile").alias("upwind_fires_national_percentile_today"),
        t("wind_speed", 1).alias("wind_speed_m_s"), C.compass_from("u10", "v10").alias("wind_from"),
        F.coalesce("by_health", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
        .alias("monitors_within_50km_by_health"),
        F.col("nearest_monitors"))
    return joined.select("date", "ord", "role", "cell", signals.alias("signals"))


def signal_names(signals: str, packs: DataFrame) -> list[str]:
    """Names a claim may cite: the top-level signals, and the fields of the location."""
    schema = packs.schema[signals].dataType
    return [*schema.names, *[f"location.{n}" for n in schema["location"].dataType.names]]

