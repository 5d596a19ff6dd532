"""The live feed: long readings, one row per station and pollutant, and the wide index table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions.scales import aqi_category
from skyhive.operators.scale import latest

# Pollutant names of the feed and the column each becomes, in tie-breaking order
POLLUTANTS = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "CO": "co", "OZONE": "o3", "NH3": "nh3"}
MIN_POLLUTANTS = 3


def live_readings(records: DataFrame, order: list[str]) -> DataFrame:
    """Typed readings from feed records in either naming scheme; the last copy of a reading wins."""
    def either(new: str, old: str):
        present = [c for c in (new, old) if c in records.columns]
        return C.number(C.first_known(*present)).alias(new) if present else F.lit(None).cast("double").alias(new)

    text = [F.trim(F.col(c)).alias(c) for c in ("state", "city", "station", "pollutant_id")]
    typed = records.select(
        C.station_slug(*[F.trim(F.col(c)) for c in ("state", "city", "station")]).alias("station_id"),
        *text, C.number("latitude").alias("latitude"), C.number("longitude").alias("longitude"),
        C.ist_text_utc("last_update").alias("last_update"),
        either("min_value", "pollutant_min"), either("max_value", "pollutant_max"),
        either("avg_value", "pollutant_avg"), *[c for c in ("snapshot", *order) if c in records.columns])
    return latest(typed, ["station_id", "pollutant_id", "last_update"], order).drop("copies")


def live_table(readings: DataFrame, order: list[str]) -> DataFrame:
    """One row per station: last value per pollutant, index, dominant pollutant, validity, category.

    Place names follow the latest update; pollutant values follow the input order. Both skip missing values.
    """
    def known(column: str, rank: list[str], among=None):
        usable = F.col(column).isNotNull() if among is None else F.col(column).isNotNull() & among
        return F.max_by(F.col(column), F.when(usable, F.struct(*rank)))

    place = [known(c, ["last_update", *order]).alias(c) for c in ("state", "city", "station", "latitude", "longitude")]
    wide = readings.groupBy("station_id").agg(
        *place, F.max("last_update").alias("last_update"),
        *[known("avg_value", order, F.col("pollutant_id") == name).alias(column)
          for name, column in POLLUTANTS.items()])
    columns = list(POLLUTANTS.values())
    top = F.greatest(*columns)
    dominant = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in columns])
    count = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    has_pm = F.col("pm25").isNotNull() | F.col("pm10").isNotNull()
    return (wide.withColumn("n_pollutants", count).withColumn("aqi", top)
            .withColumn("dominant_pollutant", dominant)
            .withColumn("aqi_valid", (count >= MIN_POLLUTANTS) & has_pm)
            .withColumn("aqi_category", aqi_category("aqi")))


def live_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("stations"), F.countDistinct("state").alias("states"),
                     F.sum(F.col("aqi_valid").cast("bigint")).alias("valid_index"))
