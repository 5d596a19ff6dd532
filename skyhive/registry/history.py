"""Cleaning, quality, station tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.operators import clean, runs, stations
from skyhive.registry.adapters import load, raw
from skyhive.registry.book import register
from skyhive.registry.sqltext import fragment, query

MIN_HOURS = 2  # the given events are sparse: about two per station and day
MONITOR_SPAN = 4 * 3600
SILENT_DAYS = 15

fragment("raw_all", "SELECT * FROM raw_once UNION ALL SELECT * FROM raw_again", "raw_once", "raw_again")
fragment("typed", """SELECT location_id, sensors_id, location, lower(trim(parameter)) AS parameter,
 CASE WHEN trim(units) = 'm/s' THEN 'm/s' ELSE 'ug/m3' END AS unit, TRY_CAST(value AS DOUBLE) AS value,
 CASE WHEN datetime = 'not a time' THEN NULL ELSE true_ts END AS timestamp_utc, lat, lon, state, line
 FROM raw_all""", "raw_all")
fragment("caps", "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{u}', CAST({c} AS DOUBLE))" for (p, u), c in clean.CEILINGS.items()) + ") t(parameter, unit, ceiling)")
fragment("judged", """SELECT t.*, CASE WHEN value IS NULL THEN 'null_value' WHEN timestamp_utc IS NULL THEN 'bad_timestamp'
 WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates' WHEN value < 0 THEN 'negative'
 WHEN value IN (999.0, 999.9, 999.99, 9999.0, 99999.0) THEN 'sentinel_999' WHEN value > ceiling THEN 'implausible_high'
 WHEN parameter = 'wind_speed' AND unit = 'm/s' AND value > 25 THEN 'wind_speed_over_25ms' END AS drop_reason
 FROM typed t LEFT JOIN caps USING (parameter, unit)""", "typed", "caps")
fragment("marked", """SELECT *, CASE WHEN drop_reason IS NOT NULL THEN drop_reason
 WHEN row_number() OVER (PARTITION BY drop_reason IS NULL, sensors_id, timestamp_utc ORDER BY line DESC) > 1
 THEN 'duplicate_sensor_timestamp' ELSE 'kept' END AS fate FROM judged""", "judged")
fragment("cleaned", "SELECT * FROM marked WHERE fate = 'kept'", "marked")


@register("normalised_records", query("SELECT line, parameter, unit, value, timestamp_utc FROM typed", "typed"))
def normalised_records(spark, sf):
    return clean.normalise(raw(spark, sf)).select("line", "parameter", "unit", "value", "timestamp_utc")


@register("judged_records", query("SELECT line, drop_reason FROM judged", "judged"))
def judged_records(spark, sf):
    return clean.judge(clean.normalise(raw(spark, sf))).select("line", "drop_reason")


@register("clean_readings", query(
    "SELECT 'site-' || location_id AS station_id, location, lat, lon, state, parameter, value, unit, timestamp_utc"
    " FROM cleaned", "cleaned"))
def clean_readings(spark, sf):
    return clean.clean(raw(spark, sf)).select(
        "station_id", "location", "lat", "lon", "state", "parameter", "value", "unit", "timestamp_utc")


def _counts(spark, sf):
    return clean.drop_counts(clean.judge(clean.normalise(raw(spark, sf))), ["line"])


@register("drop_counts", query(
    "SELECT fate AS drop_reason, parameter, state, count(*) AS rows FROM marked GROUP BY ALL", "marked"))
def drop_counts(spark, sf):
    return _counts(spark, sf)


@register("drop_ledger", query("""
SELECT 'by_reason' AS part, fate AS drop_reason, NULL::VARCHAR AS parameter, NULL::VARCHAR AS state, count(*) AS rows FROM marked GROUP BY ALL
UNION ALL SELECT 'by_parameter', fate, parameter, NULL, count(*) FROM marked GROUP BY ALL
UNION ALL SELECT 'by_state', fate, NULL, state, count(*) FROM marked GROUP BY ALL
UNION ALL SELECT 'raw_rows', NULL, NULL, NULL, count(*) FROM marked""", "marked"))
def drop_ledger(spark, sf):
    return clean.drop_ledger(_counts(spark, sf))


@register("removed_by_state", query("""SELECT state, count(*) FILTER (fate = 'wind_speed_over_25ms') AS removed,
 count(*) AS checked, round(100 * removed / checked, 6) AS share_pct FROM marked GROUP BY state HAVING removed > 0""", "marked"))
def removed_by_state(spark, sf):
    return clean.removed_share(_counts(spark, sf), "wind_speed_over_25ms")


@register("refilter_drops", query("""SELECT parameter, CASE WHEN value * 10 < 0 THEN 'negative'
 WHEN value * 10 IN (999.0, 999.9, 999.99, 9999.0, 99999.0) THEN 'sentinel_999' WHEN value * 10 > ceiling THEN 'implausible_high'
 ELSE 'kept' END AS drop_reason, count(*) AS rows FROM readings_multi LEFT JOIN caps USING (parameter, unit) GROUP BY ALL""",
                                  "readings_multi", "caps"))
def refilter_drops(spark, sf):
    scaled = load(spark, sf, "readings_multi").withColumn("value", F.col("value") * 10)
    return (clean.refilter(scaled).groupBy("parameter", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"))
            .agg(F.count(F.lit(1)).alias("rows")))


def flag_sql(source: str, span_hours: int) -> str:
    return f"""SELECT *, CASE WHEN parameter NOT IN ('pm25', 'pm10') THEN 'unchecked' WHEN value IN (985, 1985)
 THEN 'stuck_placeholder' WHEN max(timestamp_utc) OVER r - min(timestamp_utc) OVER r >= INTERVAL {span_hours} HOUR
 THEN 'stuck_run' ELSE 'ok' END AS quality_flag FROM (SELECT *, sum(brk) OVER (PARTITION BY station_id, parameter
 ORDER BY timestamp_utc, line) AS run FROM (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value
 OR timestamp_utc - lag(timestamp_utc) OVER w > INTERVAL 61 MINUTE THEN 1 ELSE 0 END AS brk FROM {source}
 WINDOW w AS (PARTITION BY station_id, parameter ORDER BY timestamp_utc, line)) a) b
 WINDOW r AS (PARTITION BY station_id, parameter, run)"""


fragment("flat_flagged", flag_sql("flat", 1), "flat")
fragment("monitor_flagged", flag_sql("monitors", 4), "monitors")


@register("quality_flags", query("SELECT line, quality_flag FROM flat_flagged", "flat_flagged"))
def quality_flags(spark, sf):
    return runs.flag_quality(load(spark, sf, "flat"), ["line"], span_seconds=3600).select("line", "quality_flag")


@register("flag_counts", query("""SELECT parameter, state, ok, stuck_placeholder, stuck_run,
 round(100 * (stuck_placeholder + stuck_run) / (ok + stuck_placeholder + stuck_run), 6) AS flagged_pct FROM (
 SELECT parameter, state, count(*) FILTER (quality_flag = 'ok') AS ok,
 count(*) FILTER (quality_flag = 'stuck_placeholder') AS stuck_placeholder,
 count(*) FILTER (quality_flag = 'stuck_run') AS stuck_run FROM flat_flagged WHERE parameter IN ('pm25', 'pm10')
 GROUP BY parameter, state)""", "flat_flagged"))
def flag_counts(spark, sf):
    return runs.flag_counts(runs.flag_quality(load(spark, sf, "flat"), ["line"], span_seconds=3600),
                            ["parameter", "state"])


@register("most_flagged_states", query("""SELECT state, count(*) FILTER (quality_flag IN ('stuck_placeholder', 'stuck_run'))
 AS flagged_rows FROM flat_flagged WHERE parameter IN ('pm25', 'pm10') GROUP BY state ORDER BY 2 DESC, 1 LIMIT 3""",
                                       "flat_flagged"))
def most_flagged_states(spark, sf):
    return runs.most_flagged(runs.flag_quality(load(spark, sf, "flat"), ["line"], span_seconds=3600), 3)


fragment("hourly", """SELECT station_id, date_trunc('hour', timestamp_utc) AS hour, avg(value) AS value
 FROM readings GROUP BY ALL""", "readings")
fragment("daily", f"""SELECT station_id, CAST(hour + INTERVAL 330 MINUTE AS DATE) AS period, avg(value) AS value,
 count(*) AS hours FROM hourly GROUP BY ALL HAVING count(*) >= {MIN_HOURS}""", "hourly")


@register("daily_means", query("SELECT station_id, period, round(value, 6) AS value, hours FROM daily", "daily"))
def daily_means(spark, sf):
    daily = stations.daily_means(stations.hourly_means(load(spark, sf, "readings")), MIN_HOURS)
    return daily.select("station_id", "period", F.round("value", 6).alias("value"), "hours")


@register("coverage", query("""SELECT station_id, count(*) AS hours, round(count(*) / (SELECT
 date_diff('second', min(hour), max(hour)) / 3600.0 + 1 FROM hourly), 9) AS coverage FROM hourly GROUP BY station_id""", "hourly"))
def coverage(spark, sf):
    return (stations.coverage(stations.hourly_means(load(spark, sf, "readings")))
            .withColumn("coverage", F.round("coverage", 9)))


def table_sql(source: str) -> str:
    return f"""SELECT station_id, arg_max(station_name, month) FILTER (station_name IS NOT NULL) AS station_name,
 quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon, arg_max(city, month) FILTER (city IS NOT NULL) AS city,
 arg_max(state, month) FILTER (state IS NOT NULL) AS state, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
 CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT station_id, strftime(timestamp_utc, '%Y-%m') AS month,
 arg_max(station_name, (timestamp_utc, line)) FILTER (station_name IS NOT NULL) AS station_name,
 quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon,
 arg_max(city, (timestamp_utc, line)) FILTER (city IS NOT NULL) AS city,
 arg_max(state, (timestamp_utc, line)) FILTER (state IS NOT NULL) AS state,
 min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen, count(*) AS rows
 FROM {source} GROUP BY station_id, month) m GROUP BY station_id"""


fragment("multi_stations", table_sql("readings_multi"), "readings_multi")
fragment("monitor_stations", table_sql("monitors"), "monitors")


@register("station_table", query("""SELECT station_id, station_name, round(lat, 6) AS lat, round(lon, 6) AS lon, city, state,
 first_seen, last_seen, rows FROM multi_stations""", "multi_stations"))
def station_table(spark, sf):
    return (stations.station_table(load(spark, sf, "readings_multi"), ["line"])
            .withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6)))


fragment("channel", """SELECT station_id, parameter, count(*) FILTER (quality_flag = 'ok') AS ok,
 count(*) FILTER (quality_flag = 'stuck_placeholder') AS placeholder, count(*) FILTER (quality_flag = 'stuck_run') AS runs,
 count(DISTINCT date_trunc('hour', timestamp_utc)) FILTER (quality_flag = 'ok') AS ok_hours,
 max(date_trunc('hour', timestamp_utc)) FILTER (quality_flag = 'ok') AS last_usable_utc
 FROM monitor_flagged WHERE parameter IN ('pm25', 'pm10') GROUP BY station_id, parameter
 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY CASE parameter WHEN 'pm25' THEN 0 ELSE 1 END) = 1""", "monitor_flagged")
fragment("monitor_health", f"""SELECT s.station_id, s.station_name, s.state, CASE WHEN c.station_id IS NULL THEN 'dead'
 WHEN flagged >= 0.2 THEN 'stuck' WHEN cover < 0.05 OR last_usable_utc IS NULL
 OR floor(date_diff('microsecond', last_usable_utc, t1) / 86400000000.0) > {SILENT_DAYS} THEN 'dead' WHEN cover < 0.5
 THEN 'intermittent' ELSE 'healthy' END AS health, parameter AS pm_channel, cover, flagged, last_usable_utc, ok, placeholder, runs
 FROM monitor_stations s LEFT JOIN (SELECT c.*, (placeholder + runs) / (ok + placeholder + runs) AS flagged,
 ok_hours / (date_diff('microsecond', t0, t1) / 3.6e9 + 1) AS cover, t1 FROM channel c, (SELECT min(timestamp_utc) AS t0,
 max(timestamp_utc) AS t1 FROM monitor_flagged WHERE parameter IN ('pm25', 'pm10')) w) c USING (station_id)""",
         "monitor_stations", "channel")


def monitors_with_health(spark, sf):
    rows = load(spark, sf, "monitors")
    flagged = runs.flag_quality(rows, ["line"], span_seconds=MONITOR_SPAN)
    return stations.station_health(stations.station_table(rows, ["line"]), flagged, silent_days=SILENT_DAYS)


REASON = """CASE WHEN pm_channel IS NULL THEN 'no PM2.5 or PM10 readings'
 WHEN health = 'stuck' THEN CAST(round_even(100 * flagged, 0) AS BIGINT) || '% of ' || pm_channel || ' readings flagged ('
 || format('{:,}', placeholder) || ' placeholder, ' || format('{:,}', runs) || ' in day-long flat runs)'
 WHEN health = 'dead' THEN 'usable ' || pm_channel || ' coverage ' || CAST(round_even(100 * cover, 0) AS BIGINT) || '%, '
 || CASE WHEN last_usable_utc IS NULL THEN 'no usable reading' ELSE 'last usable reading ' || strftime(last_usable_utc, '%Y-%m-%d') END
 ELSE 'usable ' || pm_channel || ' coverage ' || CAST(round_even(100 * cover, 0) AS BIGINT) || '%' END AS health_reason"""


@register("station_health", query(f"""SELECT station_id, health, {REASON}, pm_channel,
 round_even(coalesce(cover, 0), 3) AS usable_coverage, round_even(flagged, 3) AS flagged_share, last_usable_utc
 FROM monitor_health""", "monitor_health"))
def station_health(spark, sf):
    return monitors_with_health(spark, sf).select(
        "station_id", "health", "health_reason", "pm_channel", "usable_coverage", "flagged_share", "last_usable_utc")


@register("health_overview", query("SELECT health, count(*) AS stations FROM monitor_health GROUP BY health", "monitor_health"))
def health_overview(spark, sf):
    return stations.health_overview(monitors_with_health(spark, sf))


@register("value_profile", query("""SELECT parameter, unit, count(*) AS rows, max(value) AS max,
 round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS median,
 round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM cleaned GROUP BY ALL""", "cleaned"))
def value_profile(spark, sf):
    out = stations.value_profile(clean.clean(raw(spark, sf)))
    for name in ("p5", "median", "p95", "p99"):
        out = out.withColumn(name, F.round(name, 6))
    return out


@register("corpus_counts", query("""SELECT 'stations' AS measure, NULL::VARCHAR AS item, count(DISTINCT station_id) AS n FROM readings_multi
 UNION ALL SELECT 'states_covered', NULL, count(DISTINCT state) FROM multi_stations
 UNION ALL SELECT 'stations_without_district', NULL, count(*) FROM multi_stations WHERE city IS NULL
 UNION ALL SELECT 'rows_per_parameter', parameter, count(*) FROM readings_multi GROUP BY parameter
 UNION ALL SELECT 'stations_per_state', state, count(*) FROM multi_stations GROUP BY state""", "readings_multi", "multi_stations"))
def corpus_counts(spark, sf):
    return stations.corpus_counts(load(spark, sf, "readings_multi"))


@register("corpus_window", query("""SELECT CAST(min(timestamp_utc) + INTERVAL 330 MINUTE AS DATE) AS start,
 CAST(max(timestamp_utc) + INTERVAL 330 MINUTE AS DATE) AS "end", min(timestamp_utc) AS first_utc, max(timestamp_utc) AS last_utc
 FROM readings""", "readings"))
def corpus_window(spark, sf):
    return stations.corpus_window(load(spark, sf, "readings"))


@register("unit_consistency", query("""SELECT count(*) AS n, round(quantile_cont(ratio, 0.25), 6) AS q1,
 round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.75), 6) AS q3 FROM (
 SELECT nox * 1000 / nullif(no / 1.2271 + no2 / 1.8814, 0) AS ratio FROM (SELECT state, date_trunc('hour', timestamp_utc) AS hour,
 avg(value) FILTER (parameter = 'no') AS no, avg(value) FILTER (parameter = 'no2') AS no2, avg(value) FILTER (parameter = 'nox') AS nox
 FROM readings_multi GROUP BY ALL) WHERE no IS NOT NULL AND no2 IS NOT NULL AND nox IS NOT NULL) WHERE ratio IS NOT NULL""",
                                    "readings_multi"))
def unit_consistency(spark, sf):
    rows = load(spark, sf, "readings_multi").withColumn("station_id", F.col("state"))
    return stations.unit_consistency(rows).select("n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@register("month_partitions", query("""SELECT state, parameter, strftime(timestamp_utc, '%Y-%m') AS month, count(*) AS rows,
 count(DISTINCT station_id) AS stations FROM cleaned GROUP BY ALL""".replace("station_id", "location_id"), "cleaned"))
def month_partitions(spark, sf):
    rows = clean.clean(raw(spark, sf)).withColumn("month", F.date_format("timestamp_utc", "yyyy-MM"))
    return (rows.groupBy("state", "parameter", "month", "station_id").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("state", "parameter", "month")
            .agg(F.sum("c").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("stations")))
