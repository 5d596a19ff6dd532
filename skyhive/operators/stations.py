"""Hourly and daily means, coverage, the station table and station health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.operators.runs import PM_PARAMETERS
from skyhive.operators.scale import exact_quantiles

# Fixed values
MIN_HOURS = 18
STUCK_SHARE = 0.20
DEAD_COVERAGE = 0.05
DEAD_SILENT_DAYS = 30
HEALTHY_COVERAGE = 0.50


def hourly_means(readings: DataFrame) -> DataFrame:
    return (readings.groupBy("station_id", F.date_trunc("hour", "timestamp_utc").alias("hour"))
            .agg(F.avg("value").alias("value")))


def daily_means(hourly: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """Mean of hourly means over the calendar day in India; days with too few hours are left out."""
    return (hourly.groupBy("station_id", C.ist_day("hour").alias("period"))
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("hours"))
            .where(F.col("hours") >= min_hours))


def _hours_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(3.6e9)


def coverage(hourly: DataFrame) -> DataFrame:
    """Share of the hours between the first and the last hour of the whole corpus that a station reports."""
    span = hourly.agg((_hours_between(F.min("hour"), F.max("hour")) + 1).alias("w")).scalar()
    return (hourly.groupBy("station_id").agg(F.count(F.lit(1)).alias("hours"))
            .withColumn("coverage", F.col("hours") / span))


def eligible(cover: DataFrame, at_least: float = HEALTHY_COVERAGE) -> DataFrame:
    return cover.where(F.col("coverage") >= at_least)


def _last(value: str, order: list) -> Column:
    """Last value that is known, in order."""
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), rank))


def station_table(readings: DataFrame, tie: list[str]) -> DataFrame:
    """One row per station. The position is the median of monthly medians; names are the last ones known."""
    return merged_stations(station_months(readings, tie))


def station_months(readings: DataFrame, tie: list[str]) -> DataFrame:
    """What a month says of a station. Equal positions are counted before the median, so a busy station is a handful of rows."""
    month = F.date_format("timestamp_utc", "yyyy-MM").alias("month")
    rows = readings.select("*", month)
    middle = []
    for axis in ("lat", "lon"):
        spots = (rows.where(F.col(axis).isNotNull()).groupBy("station_id", "month", axis)
                 .agg(F.count(F.lit(1)).alias("_n")))
        middle.append(spots.groupBy("station_id", "month")
                      .agg(F.expr(f"percentile({axis}, 0.5D, _n)").alias(axis)))
    monthly = rows.groupBy("station_id", "month").agg(
        _last("station_name", ["timestamp_utc", *tie]).alias("station_name"),
        _last("city", ["timestamp_utc", *tie]).alias("city"),
        _last("state", ["timestamp_utc", *tie]).alias("state"),
        F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"),
        F.count(F.lit(1)).alias("rows"))
    for part in middle:
        monthly = monthly.join(part, ["station_id", "month"], "left")
    return monthly


def merged_stations(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("station_id").agg(
        _last("station_name", ["month"]).alias("station_name"),
        F.expr("percentile(lat, 0.5D)").alias("lat"), F.expr("percentile(lon, 0.5D)").alias("lon"),
        _last("city", ["month"]).alias("city"), _last("state", ["month"]).alias("state"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("rows").cast("bigint").alias("rows"))


def channel_health(flagged: DataFrame) -> DataFrame:
    """Counts and usable hours of each station's PM channel: PM2.5 where it has one, else PM10."""
    pm = flagged.where(F.col("parameter").isin(PM_PARAMETERS))
    window = pm.agg((_hours_between(F.min("timestamp_utc"), F.max("timestamp_utc")) + 1).alias("w")).scalar()
    corpus_end = pm.agg(F.max("timestamp_utc").alias("t")).scalar()
    # Rows collapse to station-hours first, so no distinct set of hours is ever held for one station.
    hour = F.date_trunc("hour", "timestamp_utc").alias("hour")
    flag = lambda name: F.sum((F.col("quality_flag") == name).cast("bigint"))
    hours = pm.groupBy("station_id", "parameter", hour).agg(
        flag("ok").alias("ok"), flag("stuck_placeholder").alias("placeholder"),
        flag("stuck_run").alias("runs"))
    channels = hours.groupBy("station_id", "parameter").agg(
        F.sum("ok").alias("ok"), F.sum("placeholder").alias("placeholder"), F.sum("runs").alias("runs"),
        F.sum((F.col("ok") > 0).cast("bigint")).alias("ok_hours"),
        F.max(F.when(F.col("ok") > 0, F.col("hour"))).alias("last_usable_utc"))
    return preferred_channel(channels).withColumn("usable_coverage", F.col("ok_hours") / window).withColumn("corpus_end", corpus_end)


def preferred_channel(channels: DataFrame) -> DataFrame:
    """The PM2.5 channel of a station, or its PM10 channel if it has no other, with the flagged share."""
    rank = F.when(F.col("parameter") == "pm25", 0).otherwise(1)
    row = F.struct("parameter", "ok", "placeholder", "runs", "ok_hours", "last_usable_utc")
    best = channels.groupBy("station_id").agg(F.min_by(row, rank).alias("c"))
    return (best.select("station_id", "c.*")
            .withColumn("flagged_share", (F.col("placeholder") + F.col("runs"))
                        / (F.col("ok") + F.col("placeholder") + F.col("runs"))))


def station_health(stations: DataFrame, flagged: DataFrame, silent_days: int = DEAD_SILENT_DAYS,
                   stuck_share: float = STUCK_SHARE) -> DataFrame:
    """stuck, dead, intermittent or healthy with the reason in words; stations with no PM channel are dead."""
    return judged_stations(stations, channel_health(flagged), silent_days, stuck_share)


def judged_stations(stations: DataFrame, channels: DataFrame, silent_days: int = DEAD_SILENT_DAYS,
                    stuck_share: float = STUCK_SHARE) -> DataFrame:
    known = stations.join(channels, "station_id", "left")
    has, cover = F.col("parameter").isNotNull(), F.coalesce("usable_coverage", F.lit(0.0))
    silent = F.floor((F.unix_micros("corpus_end") - F.unix_micros("last_usable_utc")) / F.lit(86_400_000_000))
    is_stuck = has & (F.col("flagged_share") >= stuck_share)
    is_dead = ~has | (cover < DEAD_COVERAGE) | F.col("last_usable_utc").isNull() | (silent > silent_days)
    health = (F.when(is_stuck, "stuck").when(is_dead, "dead")
              .when(cover < HEALTHY_COVERAGE, "intermittent").otherwise("healthy"))
    pct = lambda share: F.bround(100 * share, 0).cast("bigint").cast("string")
    base = F.concat(F.lit("usable "), F.col("parameter"), F.lit(" coverage "), pct(cover), F.lit("%"))
    since = F.when(F.col("last_usable_utc").isNull(), F.lit("no usable reading")).otherwise(
        F.concat(F.lit("last usable reading "), F.date_format("last_usable_utc", "yyyy-MM-dd")))
    reason = (F.when(~has, F.lit("no PM2.5 or PM10 readings"))
              .when(is_stuck, F.concat(
                  pct(F.col("flagged_share")), F.lit("% of "), F.col("parameter"), F.lit(" readings flagged ("),
                  F.format_number("placeholder", 0), F.lit(" placeholder, "), F.format_number("runs", 0),
                  F.lit(" in day-long flat runs)")))
              .when(is_dead, F.concat(base, F.lit(", "), since)).otherwise(base))
    return known.select(
        *stations.columns, health.alias("health"), reason.alias("health_reason"),
        F.col("parameter").alias("pm_channel"), F.bround(cover, 3).alias("usable_coverage"),
        F.bround("flagged_share", 3).alias("flagged_share"), "last_usable_utc")


def health_overview(stations: DataFrame) -> DataFrame:
    return stations.groupBy("health").agg(F.count(F.lit(1)).alias("stations"))


def value_profile(readings: DataFrame) -> DataFrame:
    """p5, median, p95, p99 and maximum of every (parameter, unit), exact instead of sampled."""
    spread = exact_quantiles(readings, ["parameter", "unit"], "value",
                             {"p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99})
    top = readings.groupBy("parameter", "unit").agg(F.count(F.lit(1)).alias("rows"), F.max("value").alias("max"))
    return top.join(spread.drop("n"), ["parameter", "unit"], "left")


def corpus_counts(readings: DataFrame) -> DataFrame:
    """Named corpus counts in long form. Distinct stations come from a two-step count."""
    seen = readings.groupBy("station_id", "state", "city", "parameter").agg(F.count(F.lit(1)).alias("rows"))
    station = seen.groupBy("station_id").agg(F.max("state").alias("state"), F.max("city").alias("city"))
    line = lambda measure, item, value: [F.lit(measure).alias("measure"), item.alias("item"),
                                         value.cast("bigint").alias("n")]
    nothing = F.lit(None).cast("string")
    totals = station.agg(F.count(F.lit(1)).alias("stations"),
                         F.countDistinct("state").alias("states"),
                         F.sum(F.col("city").isNull().cast("bigint")).alias("no_district"))
    return (totals.select(*line("stations", nothing, F.col("stations")))
            .unionByName(totals.select(*line("states_covered", nothing, F.col("states"))))
            .unionByName(totals.select(*line("stations_without_district", nothing, F.col("no_district"))))
            .unionByName(seen.groupBy("parameter").agg(F.sum("rows").alias("rows"))
                         .select(*line("rows_per_parameter", F.col("parameter"), F.col("rows"))))
            .unionByName(station.groupBy("state").agg(F.count(F.lit(1)).alias("c"))
                         .select(*line("stations_per_state", F.col("state"), F.col("c")))))


def corpus_window(readings: DataFrame) -> DataFrame:
    return readings.agg(C.ist_day(F.min("timestamp_utc")).alias("start"), C.ist_day(F.max("timestamp_utc")).alias("end"),
                        F.min("timestamp_utc").alias("first_utc"), F.max("timestamp_utc").alias("last_utc"))


def unit_consistency(readings: DataFrame) -> DataFrame:
    """Do nitrogen oxides agree with their parts? NOx x 1000 over NO + NO2 in ppb, per station and hour."""
    # ug/m3 per ppb at 25 C
    molar = {"no": 1.2271, "no2": 1.8814}
    hourly = (readings.where(F.col("parameter").isin("no", "no2", "nox"))
              .groupBy("station_id", F.date_trunc("hour", "timestamp_utc").alias("hour"))
              .agg(*[F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(p)
                     for p in ("no", "no2", "nox")]))
    parts = F.col("no") / molar["no"] + F.col("no2") / molar["no2"]
    ratio = hourly.where("no IS NOT NULL AND no2 IS NOT NULL AND nox IS NOT NULL").select(
        F.try_divide(F.col("nox") * 1000, parts).alias("ratio"))
    return exact_quantiles(ratio, [], "ratio", {"q1": 0.25, "median": 0.5, "q3": 0.75})
