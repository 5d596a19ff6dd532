"""Raw records to clean readings: every dropped row is counted once, under its first matching reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.operators.scale import latest

# Sentinel readings
SENTINELS = [999.0, 999.9, 999.99, 9999.0, 99999.0]
# Hourly wind above this is an instrument fault
WIND_LIMIT_MS = 25.0
# Fixed values: (parameter, unit) -> highest believable value
CEILINGS = {
    ("pm25", "ug/m3"): 2000.0, ("pm10", "ug/m3"): 3000.0, ("pm1", "ug/m3"): 2000.0,
    ("no2", "ug/m3"): 2000.0, ("no2", "ppb"): 1000.0, ("no2", "ppm"): 1.0,
    ("so2", "ug/m3"): 2600.0, ("so2", "ppb"): 1000.0, ("so2", "ppm"): 1.0,
    ("o3", "ug/m3"): 1000.0, ("o3", "ppb"): 500.0, ("o3", "ppm"): 0.5,
    ("co", "ug/m3"): 100000.0, ("co", "ppb"): 100000.0, ("co", "ppm"): 100.0, ("co", "mg/m3"): 100.0,
    ("nh3", "ug/m3"): 2000.0,
}
DUPLICATE = "duplicate_sensor_timestamp"


def ceilings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, u, c) for (p, u), c in CEILINGS.items()],
                                 "parameter string, unit string, ceiling double")


def normalise(raw: DataFrame) -> DataFrame:
    """Text columns to typed ones; the raw text of parameter and unit is replaced by its usual form."""
    return raw.select(
        *[c for c in raw.columns if c not in ("parameter", "units", "value", "datetime", "lat", "lon")],
        C.parameter_name("parameter").alias("parameter"),
        C.unit_name("units").alias("unit"),
        C.number("value").alias("value"),
        C.iso_utc("datetime").alias("timestamp_utc"),
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lon").try_cast("double").alias("lon"))


def value_fault(ceiling: Column) -> Column:
    """First value rule a reading breaks, or NULL. Safe to apply again to clean data."""
    value = F.col("value")
    windy = (F.col("parameter") == "wind_speed") & (F.col("unit") == "m/s") & (value > WIND_LIMIT_MS)
    return (F.when(value < 0, F.lit("negative"))
            .when(value.isin(SENTINELS), F.lit("sentinel_999"))
            .when(value > ceiling, F.lit("implausible_high"))
            .when(windy, F.lit("wind_speed_over_25ms")))


def with_ceiling(df: DataFrame) -> DataFrame:
    """The ceiling table has 17 rows, so it is always small enough to broadcast."""
    return df.join(F.broadcast(ceilings(df.sparkSession)), ["parameter", "unit"], "left")


def judge(records: DataFrame) -> DataFrame:
    """Typed records with `drop_reason`; duplicates are not judged yet."""
    unusable = (F.when(F.col("value").isNull(), F.lit("null_value"))
                .when(F.col("timestamp_utc").isNull(), F.lit("bad_timestamp"))
                .when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit("missing_coordinates")))
    return (with_ceiling(records)
            .withColumn("drop_reason", F.coalesce(unusable, value_fault(F.col("ceiling"))))
            .drop("ceiling"))


def survivors(judged: DataFrame, order: list[str]) -> DataFrame:
    """Rows without a fault, the last copy of each sensor and time; `copies` counts what it replaced."""
    return latest(judged.where("drop_reason IS NULL").drop("drop_reason"),
                  ["sensors_id", "timestamp_utc"], order)


def clean(raw: DataFrame, locations: DataFrame | None = None, order: list[str] = ("line",)) -> DataFrame:
    """Readings in their output form. `locations` adds state and city by location_id."""
    rows = survivors(judge(normalise(raw)), list(order)).drop("copies")
    if locations is not None:
        rows = rows.join(locations.select("location_id", "state", "city"), "location_id", "left")
    return rows.withColumn("station_id", F.concat(F.lit("site-"), F.col("location_id").cast("string")))


def drop_counts(judged: DataFrame, order: list[str], by: list[str] = ("parameter", "state")) -> DataFrame:
    """Rows by reason and grouping columns, kept rows under the reason 'kept'."""
    by = list(by)
    faults = (judged.where("drop_reason IS NOT NULL")
              .groupBy("drop_reason", *by).agg(F.count(F.lit(1)).alias("rows")))
    alive = survivors(judged, order)
    kept = alive.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    total = (judged.where("drop_reason IS NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("rows")))
    copies = (total.alias("t").join(kept.alias("k"), by, "left")
              .select(*by, (F.col("t.rows") - F.coalesce(F.col("k.rows"), F.lit(0))).alias("rows"))
              .where("rows > 0"))
    columns = ["drop_reason", *by, "rows"]
    return (faults.select(columns)
            .unionByName(copies.withColumn("drop_reason", F.lit(DUPLICATE)).select(columns))
            .unionByName(kept.withColumn("drop_reason", F.lit("kept")).select(columns)))


def drop_ledger(counts: DataFrame) -> DataFrame:
    """The ledger in its published groupings: by reason, parameter x reason, reason x state, and totals."""
    view = counts.withColumn("state", F.coalesce("state", F.lit("unknown")))
    grouped = view.groupingSets(
        [["drop_reason"], ["parameter", "drop_reason"], ["drop_reason", "state"], []],
        "drop_reason", "parameter", "state").agg(
            F.sum("rows").cast("bigint").alias("rows"),
            F.grouping("parameter").alias("_p"), F.grouping("state").alias("_s"),
            F.grouping("drop_reason").alias("_r"))
    part = (F.when(F.col("_r") == 1, "raw_rows").when(F.col("_p") == 0, "by_parameter")
            .when(F.col("_s") == 0, "by_state").otherwise("by_reason"))
    return grouped.select(part.alias("part"), "drop_reason", "parameter", "state", "rows")


def removed_share(counts: DataFrame, reason: str) -> DataFrame:
    """Rows one rule removed in each state, with rows checked and the share in percent."""
    hit = F.sum(F.when(F.col("drop_reason") == reason, F.col("rows")).otherwise(0))
    return (counts.groupBy("state")
            .agg(hit.cast("bigint").alias("removed"), F.sum("rows").cast("bigint").alias("checked"))
            .where("removed > 0")
            .withColumn("share_pct", F.round(100 * F.col("removed") / F.col("checked"), 6)))


def refilter(readings: DataFrame) -> DataFrame:
    """Value rules on readings that are already clean: the same rows plus `drop_reason`."""
    return with_ceiling(readings).withColumn("drop_reason", value_fault(F.col("ceiling"))).drop("ceiling")
