"""Photo readings as virtual sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhive.functions.scales import fuse, haze_conflict, haze_range, photo_weight


def observations(readings: DataFrame) -> DataFrame:
    """Clamped scores, the PM2.5 range of the haze, self-consistency and the effective confidence.

    A photo without sky is no observation, whatever its numbers say.
    """
    band = haze_range("haze_severity")
    sky = F.coalesce(F.col("sky_visible"), F.lit(False))
    when_sky = lambda c: F.when(sky, c)
    return (readings
            .withColumn("_band", band)
            .withColumn("status", F.when(sky, "ok").otherwise("no_sky"))
            .withColumn("pm25_low", when_sky(F.col("_band.low"))).withColumn("pm25_high", when_sky(F.col("_band.high")))
            .withColumn("pm25_mid", when_sky((F.col("_band.low") + F.col("_band.high")) / 2))
            .withColumn("pm25_category", when_sky(F.col("_band.label")))
            .withColumn("consistency_warning", when_sky(haze_conflict("visibility_km_estimate", "haze_severity")))
            .withColumn("effective_confidence", photo_weight(sky, "confidence", "visibility_km_estimate", "haze_severity"))
            .drop("_band"))


def fused(predictions: DataFrame, photos: DataFrame) -> DataFrame:
    """Predictions of cells with a photo, blended with it. predictions: cell, pm25, uncertainty."""
    both = photos.join(predictions.select("cell", "pm25", "uncertainty"), "cell")
    blend = fuse("pm25", "uncertainty", "pm25_low", "pm25_high", "effective_confidence")
    return both.withColumn("f", blend).select(
        "id", "cell", "pm25", "status", F.col("f.fused").alias("fused_pm25"),
        F.col("f.uncertainty").alias("fused_uncertainty"), F.col("f.photo_weight").alias("photo_weight"))
