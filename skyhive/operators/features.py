"""The feature table by cell and day, its profile, and the train/serve comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions import geo
from skyhive.operators.scale import exact_quantiles

# Feature groups
SATELLITE = ["no2_trop", "aai", "co", "so2"]
WIND = ["wind_speed", "wind_dir_sin", "wind_dir_cos"]
FIRE_OWN = ["fire_count", "frp_sum"]
FIRE_REGION = ["fires_150km", "frp_150km", "upwind_fires_150km", "upwind_frp_150km"]
CALENDAR = ["doy_sin", "doy_cos", "month", "weekday"]
PLACE = ["lat", "lon"]
NEIGHBOUR = ["neighbour_idw", "neighbour_nearest", "dist_nearest_km", "n_reporting", "neighbour_spread"]
FEATURES = SATELLITE + WIND + FIRE_OWN + FIRE_REGION + CALENDAR + PLACE + NEIGHBOUR
FEATURE_GROUPS = {"Satellite columns": SATELLITE, "Location (lat/lon)": PLACE, "Neighbour stations": NEIGHBOUR,
                  "Wind, fire, season": WIND + FIRE_OWN + FIRE_REGION + CALENDAR}
SKEW_CHECKED = SATELLITE + ["wind_speed", "fire_count", "fires_150km", "upwind_fires_150km"]


def cell_day_features(satellite: DataFrame, own_fires: DataFrame, regional_fires: DataFrame, res: int,
                      region_res: int = 5) -> DataFrame:
    """Every feature that needs no station: satellite, wind, fires here and around, calendar, place.

    No detection means zero fires. Upwind sums are zero when no fire is in reach, and stay NULL only where
    the wind itself is missing. Fires are sparse, so adaptive execution decides at run time how to join them.
    """
    wind = {"wind_speed": C.wind_speed("u10", "v10"), "wind_dir_sin": C.wind_sin("u10", "v10"),
            "wind_dir_cos": C.wind_cos("u10", "v10")}
    base = satellite.select("cell", "date", *SATELLITE, "u10", "v10", *[e.alias(n) for n, e in wind.items()])
    own = own_fires.select("cell", "date", *FIRE_OWN)
    around = regional_fires.select("region_cell", "date", *FIRE_REGION)
    joined = (base.join(own, ["cell", "date"], "left")
              .withColumn("region_cell", geo.parent("cell", region_res, res))
              .join(around, ["region_cell", "date"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    quiet = F.coalesce(F.col("fires_150km"), F.lit(0.0)) == 0
    upwind = lambda c: F.coalesce(F.col(c), F.when(quiet, F.lit(0.0))).alias(c)
    return joined.select(
        "cell", "date", *SATELLITE, "u10", "v10", *WIND,
        F.coalesce("fire_count", F.lit(0)).alias("fire_count"), zero("frp_sum"),
        zero("fires_150km"), zero("frp_150km"), upwind("upwind_fires_150km"), upwind("upwind_frp_150km"),
        *[e.alias(n) for n, e in C.calendar("date").items()],
        geo.centroid_lat("cell", res).alias("lat"), geo.centroid_lon("cell", res).alias("lon"))


def only_cells(table: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of the listed cells: the training table keeps station cells only."""
    return table.join(cells.select("cell").distinct(), "cell", "left_semi")


def _long(table: DataFrame, features: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return table.select(F.explode(entries).alias("e")).select("e.feature", "e.value")


def feature_profile(table: DataFrame, features: list[str]) -> DataFrame:
    """Share known, median and p95 of each feature."""
    long = _long(table, features)
    known = long.groupBy("feature").agg((100 * F.count("value") / F.count(F.lit(1))).alias("non_null_pct"))
    spread = exact_quantiles(long, ["feature"], "value", {"median": 0.5, "p95": 0.95}).drop("n")
    return known.join(spread, "feature", "left")


def most_missing(table: DataFrame, features: list[str], n: int = 4) -> DataFrame:
    share = (_long(table, features).groupBy("feature")
             .agg((100 * F.avg(F.col("value").isNull().cast("double"))).alias("missing_pct")))
    return share.orderBy(F.desc("missing_pct"), "feature").limit(n)


def skew(served: DataFrame, trained: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Largest relative difference of each feature on the cell-days both sides have.

    Missing on one side only counts as infinitely different.
    """
    features = features or SKEW_CHECKED
    pair = served.alias("s").join(trained.alias("t"), ["cell", "date"])

    def gap(name: str) -> Column:
        a, b = F.col(f"s.{name}").cast("double"), F.col(f"t.{name}").cast("double")
        relative = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9))
        return F.when(a.isNull() & b.isNull(), 0.0).when(
            a.isNull() | b.isNull(), F.lit(float("inf"))).otherwise(relative)

    worst = pair.agg(F.count(F.lit(1)).alias("compared"), *[F.max(gap(f)).alias(f) for f in features])
    lines = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("worst")) for f in features])
    return worst.select("compared", F.explode(lines).alias("l")).select("l.feature", "compared", "l.worst")


def feature_group(feature) -> Column:
    column = F.col(feature) if isinstance(feature, str) else feature
    chain = None
    for name, members in FEATURE_GROUPS.items():
        test = column.isin(members)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain

