"""Station health from monthly state: a month's readings are read once, later questions merge months.

Three tables, each partitioned by month: `stations` (what a month says of a station), `hours` (a bitmap of the hours with
readings) and `channels` (counts and hours of a PM channel). A month is loaded whole, all its stations together, and loading
it again replaces it. A flat run may go on over midnight of the first, so the first and the last run of a month stay
apart from the sums until the months around them are known; the rest of a month never changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyhive.operators import stations as S
from skyhive.operators.runs import MAX_GAP_SECONDS, PM_PARAMETERS, STUCK_SPAN_SECONDS, quality_flag, with_runs
from skyhive.sinks.tables import replace_partitions

INNER, FIRST, LAST = 0, 1, 2  # a month's runs: those between, its first one, its last one if that is another


def _month(ts: str = "timestamp_utc") -> Column:
    return F.date_format(ts, "yyyy-MM").alias("month")


def hour_bitmap(ts: str, where: Column | None = None) -> Column:
    """Set of hours of a month, as an aggregate: at most 744 of the 32,768 bits of one bitmap."""
    hour = F.floor((F.unix_seconds(ts) - F.unix_seconds(F.date_trunc("month", ts))) / 3600) + 1
    position = F.bitmap_bit_position(hour)
    return F.bitmap_construct_agg(position if where is None else F.when(where, position))


def hour_months(readings: DataFrame) -> DataFrame:
    """station_id, month, hours (bitmap), first_hour, last_hour. One row a task, station and month is shuffled, never an hour."""
    hour = F.date_trunc("hour", "timestamp_utc")
    return readings.groupBy("station_id", _month()).agg(
        hour_bitmap("timestamp_utc").alias("hours"), F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))


def merged_coverage(hours: DataFrame) -> DataFrame:
    """stations.coverage() from hour_months(): months share no hour, so their counts add up."""
    span = hours.agg((S._hours_between(F.min("first_hour"), F.max("last_hour")) + 1).alias("w")).scalar()
    return (hours.groupBy("station_id").agg(F.sum(F.bitmap_count("hours")).cast("bigint").alias("hours"))
            .withColumn("coverage", F.col("hours") / span))


def channel_months(readings: DataFrame, tie: list[str], gap_seconds: int = MAX_GAP_SECONDS,
                   span_seconds: int = STUCK_SPAN_SECONDS) -> DataFrame:
    """Up to three rows a station, PM parameter and month: inner runs judged and summed, both outer runs as they are."""
    pm = readings.where(F.col("parameter").isin(PM_PARAMETERS)).select("station_id", "parameter", _month(), "timestamp_utc", "value", *tie)
    series = ["station_id", "parameter", "month"]
    rows = with_runs(pm, series, "timestamp_utc", "value", tie, gap_seconds, run="run")
    ends = rows.groupBy(*series).agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    edge = (F.when(F.col("run") == F.col("first_run"), FIRST).when(F.col("run") == F.col("last_run"), LAST).otherwise(INNER))
    rows = rows.join(ends, series).withColumn("edge", edge).withColumn("quality_flag", quality_flag(span_seconds))
    counted = F.col("edge") == INNER
    flag = lambda name: F.sum((counted & (F.col("quality_flag") == name)).cast("bigint"))
    good = ~counted | (F.col("quality_flag") == "ok")  # an outer run is good or bad as a whole, known when months meet
    return rows.groupBy(*series, "edge").agg(
        flag("ok").alias("ok"), flag("stuck_placeholder").alias("placeholder"), flag("stuck_run").alias("runs"),
        F.count(F.lit(1)).alias("rows"), F.max("value").alias("value"),
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        hour_bitmap("timestamp_utc", good).alias("hours"),
        F.max(F.when(good, F.date_trunc("hour", "timestamp_utc"))).alias("last_hour"),
        F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"))


def merged_channels(months: DataFrame, gap_seconds: int = MAX_GAP_SECONDS, span_seconds: int = STUCK_SPAN_SECONDS) -> DataFrame:
    """stations.channel_health() from channel_months(): outer runs are chained over months, then judged by their whole span."""
    series = ["station_id", "parameter"]
    chain = Window.partitionBy(*series).orderBy("month", "edge")
    outer = months.where(F.col("edge") != INNER)
    apart = F.unix_micros("run_start") - F.unix_micros(F.lag("run_end").over(chain))
    goes_on = (F.col("edge") == FIRST) & (F.lag("value").over(chain) == F.col("value")) & (apart <= gap_seconds * 1_000_000)
    outer = outer.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_island", F.sum("_new").over(chain))
    island = Window.partitionBy(*series, "_island")
    outer = outer.withColumns({"run_start": F.min("run_start").over(island), "run_end": F.max("run_end").over(island)})
    outer = outer.withColumn("flag", quality_flag(span_seconds))
    outer = outer.withColumns({name: F.when(F.col("flag") == flag, F.col("rows")).otherwise(F.lit(0).cast("bigint")) for name, flag in
                               (("ok", "ok"), ("placeholder", "stuck_placeholder"), ("runs", "stuck_run"))})
    inner = months.where(F.col("edge") == INNER).withColumn("flag", F.lit("ok"))
    good = F.col("flag") == "ok"
    monthly = inner.select(*months.columns, "flag").unionByName(outer.select(*months.columns, "flag")).groupBy(*series, "month").agg(
        *[F.sum(c).alias(c) for c in ("ok", "placeholder", "runs")],
        F.bitmap_count(F.bitmap_or_agg(F.when(good, F.col("hours")))).alias("ok_hours"), F.max(F.when(good, F.col("last_hour"))).alias("last_usable_utc"))
    channels = monthly.groupBy(*series).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("ok", "placeholder", "runs", "ok_hours")], F.max("last_usable_utc").alias("last_usable_utc"))
    window = months.agg((S._hours_between(F.min("first_seen"), F.max("last_seen")) + 1).alias("w")).scalar()
    corpus_end = months.agg(F.max("last_seen").alias("t")).scalar()
    return S.preferred_channel(channels).withColumn("usable_coverage", F.col("ok_hours") / window).withColumn("corpus_end", corpus_end)


def load_months(readings: DataFrame, root: str, months: list[str], tie: list[str], gap_seconds: int = MAX_GAP_SECONDS,
                span_seconds: int = STUCK_SPAN_SECONDS) -> None:
    """Whole months ('yyyy-MM') of clean readings into the history and the three state tables below `root`.

    Readings of other months are left out, and other months of the history are not read. A failed load is repaired by
    loading the same months again. The bounds of flat runs must be those that health() is asked with.
    """
    fresh = readings.withColumn("month", _month()).where(F.col("month").isin(months))
    replace_partitions(fresh, f"{root}/history")
    rows = (readings.sparkSession.read.schema(fresh.schema).parquet(f"{root}/history")
            .where(F.col("month").isin(months)).select(*readings.columns))
    for name, state in (("stations", S.station_months(rows, tie)), ("hours", hour_months(rows)),
                        ("channels", channel_months(rows, tie, gap_seconds, span_seconds))):
        replace_partitions(state, f"{root}/{name}", ["month"])


def _state(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").withColumn("month", F.col("month").cast("string"))


def coverage(spark: SparkSession, root: str) -> DataFrame:
    return merged_coverage(_state(spark, root, "hours"))


def health(spark: SparkSession, root: str, silent_days: int = S.DEAD_SILENT_DAYS, stuck_share: float = S.STUCK_SHARE,
           gap_seconds: int = MAX_GAP_SECONDS, span_seconds: int = STUCK_SPAN_SECONDS) -> DataFrame:
    """The station table with health of all months loaded so far. Reads the state alone."""
    table = S.merged_stations(_state(spark, root, "stations"))
    return S.judged_stations(table, merged_channels(_state(spark, root, "channels"), gap_seconds, span_seconds), silent_days, stuck_share)
