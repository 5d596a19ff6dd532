"""Category scales, distance bands, confidence, and the photo-haze prior."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# National index bands, upper edge inclusive
AQI_SCALE = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor"),
             (math.inf, "Severe")]
# 24-hour PM2.5 bands
PM25_SCALE = [(30, "Good"), (60, "Satisfactory"), (90, "Moderate"), (120, "Poor"), (250, "Very poor"),
              (math.inf, "Severe")]
# Distance to the nearest reporting monitor, lower edge inclusive
DISTANCE_BANDS = [(0, 20, "0-20 km"), (20, 50, "20-50 km"), (50, 100, "50-100 km"), (100, math.inf, "100 km+")]
BAND_NAMES = [name for _, _, name in DISTANCE_BANDS]
NO_BAND = "no remaining data"
# Display bins of the distance map
GAP_BINS = [(5, "< 5"), (10, "5–10"), (25, "10–25"), (50, "25–50"), (100, "50–100"), (200, "100–200"),
            (math.inf, "200+")]
# Confidence by distance band
CONFIDENCE_NAMES = ["high", "medium", "low"]
BAND_CONFIDENCE = {"0-20 km": 0, "20-50 km": 1, "50-100 km": 1, "100 km+": 2}
# Haze score below -> PM2.5 low, high, label
HAZE_SCALE = [(20, 0, 30, "Good"), (40, 31, 60, "Satisfactory"), (60, 61, 120, "Moderate to Poor"),
              (80, 121, 250, "Very poor"), (101, 251, 400, "Severe")]
HAZE_CONFLICT_WEIGHT = 0.2


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _steps(value: Column, edges: list[tuple[float, object]], inclusive: bool) -> Column:
    """First label whose upper edge is not passed; NULL stays NULL."""
    *bounded, (_, last) = edges
    chain = F.when(value.isNull(), None)
    for edge, label in bounded:
        chain = chain.when(value <= edge if inclusive else value < edge, F.lit(label))
    return chain.otherwise(F.lit(last))


def aqi_category(value) -> Column:
    return _steps(_col(value), AQI_SCALE, inclusive=True)


def pm25_label(value) -> Column:
    """Display category: a value on an edge belongs to the lower class."""
    return _steps(_col(value), PM25_SCALE, inclusive=True)


def pm25_class(value) -> Column:
    """Scoring category 0..5: a value on an edge belongs to the upper class."""
    return _steps(_col(value), [(edge, i) for i, (edge, _) in enumerate(PM25_SCALE)], inclusive=False)


def distance_band(km) -> Column:
    km = _col(km)
    return F.coalesce(_steps(km, [(hi, name) for _, hi, name in DISTANCE_BANDS], inclusive=False), F.lit(NO_BAND))


def gap_bin(km) -> Column:
    return _steps(_col(km), GAP_BINS, inclusive=False)


def confidence_level(km) -> Column:
    """0 high, 1 medium, 2 low; an unknown distance is low."""
    km = _col(km)
    edges = [(hi, BAND_CONFIDENCE[name]) for _, hi, name in DISTANCE_BANDS]
    return F.coalesce(_steps(km, edges, inclusive=False), F.lit(2))


def confidence_name(level) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in CONFIDENCE_NAMES]), _col(level).cast("int") + 1)


def _clamped(value, low, high) -> Column:
    """Within the limits; unknown stays unknown (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def haze_range(score) -> Column:
    """struct(low, high, label) of PM2.5 for a haze score clamped to 0..100; NULL for an unknown score."""
    score = _clamped(_col(score).cast("int"), 0, 100)
    *bounded, last = HAZE_SCALE
    as_struct = lambda row: F.struct(F.lit(row[1]).alias("low"), F.lit(row[2]).alias("high"),
                                     F.lit(row[3]).alias("label"))
    chain = F.when(score.isNull(), None)
    for row in bounded:
        chain = chain.when(score < row[0], as_struct(row))
    return chain.otherwise(as_struct(last))


def haze_conflict(visibility_km, score) -> Column:
    """Near-zero visibility together with a low haze score: the reading contradicts itself."""
    score = _clamped(_col(score).cast("int"), 0, 100)
    return (F.round(_col(visibility_km), 1) <= 2) & (score < 50)


def photo_weight(sky_visible, confidence, visibility_km, score) -> Column:
    """Effective confidence of one photo reading."""
    damped = _clamped(_col(confidence).cast("double"), 0.0, 1.0) * F.when(haze_conflict(visibility_km, score), HAZE_CONFLICT_WEIGHT).otherwise(1.0)
    return F.when(_col(sky_visible), F.bround(damped, 2)).otherwise(F.lit(0.0))


def fuse(prediction, uncertainty, low, high, weight) -> Column:
    """Inverse-variance blend of a prediction and one photo range: struct(fused, uncertainty, weight).

    A usable photo with an unknown prediction or uncertainty gives unknown values, not certain ones.
    """
    prediction, low, high = (_col(c).cast("double") for c in (prediction, low, high))
    weight = _col(weight).cast("double")
    sigma_model = F.when(_col(uncertainty).isNotNull(), F.greatest(_col(uncertainty).cast("double"), F.lit(1.0)))
    sigma_photo = (high - low) / 2 / F.greatest(weight, F.lit(0.05))
    precision_photo, precision_model = 1 / (sigma_photo * sigma_photo), 1 / (sigma_model * sigma_model)
    share = precision_photo / (precision_photo + precision_model)
    blended = share * (low + high) / 2 + (1 - share) * prediction
    usable = weight.isNotNull() & (weight > 0) & low.isNotNull()
    return F.struct(
        F.when(usable, F.round(blended, 1)).otherwise(prediction).alias("fused"),
        F.when(usable, F.round(F.sqrt(1 / (precision_photo + precision_model)), 1)).alias("uncertainty"),
        F.when(usable, F.round(share, 3)).otherwise(F.lit(0.0)).alias("photo_weight"))
