"""Daily estimates for every cell: features of the day, routing, confidence, uncertainty, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhive.functions.scales import confidence_level, distance_band
from skyhive.operators.neighbours import neighbour_features
from skyhive.operators.scale import exact_quantiles

# Fixed values of the dark-zone rule and the digest
POOR_ABOVE = 90.0
DARK_KM = 50.0


def serving_rows(grid: DataFrame, cell_days: DataFrame, values: DataFrame, k: int = 8) -> DataFrame:
    """All grid cells of all days in `cell_days` with neighbour features; every reporting station counts."""
    rows = cell_days.join(grid.select("cell", "dist_working_km"), "cell")
    asked = rows.select("cell", F.col("date").alias("period"), F.col("lat").alias("cell_lat"),
                        F.col("lon").alias("cell_lon"))
    near = neighbour_features(asked, values, k, hide_own_cell=False).withColumnRenamed("period", "date")
    return rows.join(near, ["cell", "date"], "left")


def route(rows: DataFrame, near: str, far: str, threshold_km: float = 100.0, name: str = "estimate") -> DataFrame:
    """Near model within the threshold, far model beyond it or where no station reports."""
    within = F.coalesce(F.col("dist_nearest_km") <= threshold_km, F.lit(False))
    return rows.withColumn(name, F.when(within, F.col(near)).otherwise(F.col(far)))


def with_confidence(rows: DataFrame, levels: DataFrame, estimate: str = "estimate") -> DataFrame:
    """pm25 clipped at zero (unknown where there is no estimate), confidence level by distance, and the typical
    error in the same unit.

    levels has one row per confidence level, three in all.
    """
    scored = (rows.withColumn("pm25", F.when(F.col(estimate).isNotNull(), F.greatest(F.col(estimate), F.lit(0.0))))
              .withColumn("confidence", confidence_level("dist_nearest_km"))
              .withColumn("band", distance_band("dist_nearest_km")))
    table = levels.select(F.col("level").alias("confidence"), "rel_error_pct")
    return (scored.join(F.broadcast(table), "confidence", "left")
            .withColumn("uncertainty", F.col("pm25") * F.col("rel_error_pct") / 100))


def dark_zone():
    return (F.col("pm25") > POOR_ABOVE) & (F.col("dist_working_km") > DARK_KM)


def digest(predicted: DataFrame) -> DataFrame:
    """Per day: cells, median, share above 90, share of low confidence, share of dark zones."""
    share = lambda test: 100 * F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    shares = predicted.groupBy("date").agg(
        F.count(F.lit(1)).alias("cells"), share(F.col("pm25") > POOR_ABOVE).alias("poor_pct"),
        share(F.col("confidence") >= 2).alias("low_confidence_pct"), share(dark_zone()).alias("dark_pct"))
    middle = exact_quantiles(predicted, ["date"], "pm25", {"median": 0.5}).drop("n")
    return shares.join(middle, "date", "left")
