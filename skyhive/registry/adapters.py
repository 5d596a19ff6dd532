"""Shapes the given tables into the schemas the operators read.

Every adapter is a SELECT list in the part of SQL that Spark and DuckDB share, so the Spark side and the
check run on the same inputs. All of them run over whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.operators.raster import Header

# A station is a user; stations crowd around twelve centres, every 25th stands far out.
STATION_LAT = ("CAST(9 AS DOUBLE) + 2.2E0 * (user_id % 12) + 0.012E0 * ((user_id * 37) % 101 - 50)"
               " * (CASE WHEN user_id % 25 = 7 THEN 4 ELSE 1 END)")
STATION_LON = ("CAST(70 AS DOUBLE) + 2.0E0 * ((user_id % 12) * 5 % 12) + 0.012E0 * ((user_id * 53) % 103 - 51)"
               " * (CASE WHEN user_id % 25 = 7 THEN 4 ELSE 1 END)")
STATION_ID = "'st-' || CAST(user_id AS STRING)"
STATION_STATE = "'State ' || CAST(user_id % 5 AS STRING)"
STATION_CITY = "CASE WHEN user_id % 9 = 4 THEN NULL ELSE 'City ' || CAST(user_id % 12 AS STRING) END"
FIVE = ("CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2'"
        " WHEN 'signup' THEN 'nox' ELSE 'no' END")

# name -> (table, select list)
SHAPES: dict[str, tuple[str, list[str]]] = {
    # all events as PM2.5
    "readings": ("events", [
        f"{STATION_ID} AS station_id", "'Station ' || CAST(user_id AS STRING) AS station_name",
        f"{STATION_LAT} AS lat", f"{STATION_LON} AS lon", f"{STATION_CITY} AS city", f"{STATION_STATE} AS state",
        "'pm25' AS parameter", "value", "'ug/m3' AS unit", "ts AS timestamp_utc", "'ok' AS quality_flag",
        "event_id AS line", "CASE WHEN user_id % 7 = 3 THEN 'dead' ELSE 'healthy' END AS health"]),
    # parameter by event type
    "readings_multi": ("events", [
        f"{STATION_ID} AS station_id", "'Station ' || CAST(user_id AS STRING) AS station_name",
        f"{STATION_LAT} + 0.001E0 * (event_id % 3) AS lat", f"{STATION_LON} AS lon", f"{STATION_CITY} AS city",
        f"{STATION_STATE} AS state", f"{FIVE} AS parameter",
        "value / (CASE WHEN event_type = 'signup' THEN 1000 ELSE 1 END) AS value", "'ug/m3' AS unit",
        "ts AS timestamp_utc", "'ok' AS quality_flag", "event_id AS line"]),
    # few busy lines with coarse values, so that flat runs occur
    "flat": ("events", [
        "'line-' || CAST(user_id % 8 AS STRING) AS station_id", f"{STATION_STATE} AS state",
        "CASE WHEN event_type = 'error' THEN 'no2' WHEN event_type = 'click' THEN 'pm10' ELSE 'pm25' END AS parameter",
        "CASE WHEN event_id % 211 = 0 THEN CAST(985 AS DOUBLE) ELSE floor(value / 60) END AS value",
        "ts AS timestamp_utc", "event_id AS line"]),
    # monitors of every kind of health: busy ones, a stuck one, sparse ones, silent ones, some without PM
    "monitors": ("events", [
        "CASE WHEN user_id % 2 = 0 THEN 'busy-' || CAST(user_id % 4 AS STRING)"
        " ELSE 'sparse-' || CAST(user_id % 40 AS STRING) END AS station_id", f"{STATION_STATE} AS state",
        "CASE WHEN user_id % 40 = 7 THEN 'co' WHEN user_id % 40 = 5 THEN 'pm10'"
        " WHEN user_id % 8 = 3 AND ts > TIMESTAMP '2024-01-08 00:00:00' THEN 'no2' ELSE 'pm25' END AS parameter",
        "CASE WHEN event_id % 211 = 0 THEN CAST(985 AS DOUBLE) WHEN user_id % 4 = 2 THEN CAST(42 AS DOUBLE)"
        " ELSE value END AS value", "ts AS timestamp_utc", "event_id AS line",
        "'Monitor ' || CAST(user_id % 40 AS STRING) AS station_name", f"{STATION_LAT} AS lat",
        f"{STATION_LON} AS lon", f"{STATION_CITY} AS city"]),
    # untidy text records; every fortieth was sent twice, with another value the second time
    "raw_once": ("events", [
        "user_id AS location_id", "user_id * 10 AS sensors_id", "'Station ' || CAST(user_id AS STRING) AS location",
        "CASE WHEN event_id % 97 = 5 THEN 'not a time' WHEN event_id % 2 = 0 THEN CAST(ts AS STRING) || '+00:00'"
        " ELSE CAST(ts + INTERVAL 330 MINUTE AS STRING) || '+05:30' END AS datetime",
        f"CASE WHEN event_id % 89 = 3 THEN NULL ELSE {STATION_LAT} END AS lat", f"{STATION_LON} AS lon",
        "CASE event_type WHEN 'view' THEN ' PM25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'NO2 '"
        " WHEN 'signup' THEN 'so2' ELSE 'wind_speed' END AS parameter",
        "CASE WHEN event_type = 'error' THEN 'm/s' WHEN event_id % 3 = 0 THEN ' ug/m³' WHEN event_id % 3 = 1 THEN 'µg/m3'"
        " ELSE 'UG/M3' END AS units",
        "CASE event_id % 50 WHEN 0 THEN 'NA' WHEN 1 THEN '-5' WHEN 2 THEN '999' WHEN 3 THEN '2500'"
        " ELSE CAST(CASE WHEN event_type = 'error' THEN value / 15 ELSE value END AS STRING) END AS value",
        f"{STATION_STATE} AS state", "event_id AS line", "ts AS true_ts"]),
    # what the live feed sends: text times in India, numbers as text, older and newer field names
    "feed": ("events", [
        "' State ' || CAST(user_id % 5 AS STRING) AS state", "'City ' || CAST(user_id % 12 AS STRING) || ' ' AS city",
        "'Stn (' || CAST(user_id AS STRING) || ')' AS station",
        f"CAST({STATION_LAT} AS STRING) AS latitude", f"CAST({STATION_LON} AS STRING) AS longitude",
        "ts", "CASE event_type WHEN 'view' THEN 'PM2.5' WHEN 'click' THEN 'PM10' WHEN 'purchase' THEN 'NO2'"
        " WHEN 'signup' THEN 'OZONE' ELSE 'CO' END AS pollutant_id",
        "CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS STRING) END AS avg_value",
        "CASE WHEN event_id % 2 = 1 THEN (CASE WHEN event_id % 7 = 0 THEN 'NA' ELSE CAST(floor(value) AS STRING) END) END"
        " AS pollutant_avg",
        "event_id AS line"]),
    "detections": ("lineitem", [
        "CAST(9 AS DOUBLE) + 0.022E0 * ((l_partkey * 37) % 1000) AS latitude",
        "CAST(70 AS DOUBLE) + 0.02E0 * ((l_partkey * 61) % 997) AS longitude",
        "DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS acq_date",
        "CAST((l_orderkey % 4) * 600 + l_linenumber % 2 * 45 AS INT) AS acq_time", "l_quantity AS frp",
        "CASE WHEN l_quantity < 5 THEN 'l' WHEN l_quantity < 25 THEN 'n' ELSE 'h' END AS confidence",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'D' ELSE 'N' END AS daynight",
        "CASE WHEN l_linestatus = 'F' THEN 'A_SP' ELSE 'A_NRT' END AS source",
        "CASE WHEN l_orderkey % 30 IN (5, 11) OR l_partkey % 3 = 0 THEN 'B_SP' ELSE 'A_SP' END AS satellite",
        "CASE WHEN l_linestatus <> 'F' THEN NULL WHEN l_partkey % 40 = 1 THEN 2 WHEN l_linenumber = 7 THEN 3 ELSE 0 END AS type",
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]),
    # overpasses of a coarse raster; 'final' scenes and early ones
    "scenes": ("lineitem", [
        "DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS date",
        "CAST((l_partkey * 7 + l_orderkey) % 60 AS INT) AS row",
        "CAST((l_suppkey * 13 + l_linenumber * 17 + l_orderkey * 3) % 60 AS INT) AS col",
        "l_linestatus = 'F' AS final",
        "CASE WHEN l_linenumber = 7 THEN CAST(-9999 AS DOUBLE) ELSE l_discount * 0.001E0 END AS no2_trop",
        "CASE WHEN l_linenumber = 6 THEN CAST(-9999 AS DOUBLE) ELSE l_tax * 20 + 0.3E0 END AS aai",
        "l_quantity * 0.001E0 AS co", "l_extendedprice * 1E-8 AS so2",
        "CASE WHEN l_linenumber = 5 THEN CAST(-9999 AS DOUBLE) ELSE l_quantity * 0.2E0 - 5 END AS u10",
        "CASE WHEN l_linenumber = 5 THEN CAST(-9999 AS DOUBLE) ELSE l_discount * 100 - 4 END AS v10"]),
    "states_box": ("nation", [
        "n_nationkey AS ord", "'State ' || CAST(n_nationkey AS STRING) AS name",
        "CAST(70 + 4 * (n_nationkey % 5) AS DOUBLE) AS x0", "CAST(10 + 4 * floor(n_nationkey / 5) AS DOUBLE) AS y0",
        "n_nationkey % 5 = 2 AS holed"]),
    "districts_box": ("supplier", [
        "s_suppkey AS ord", "'District ' || CAST(s_suppkey AS STRING) AS name",
        "CAST(70.5E0 AS DOUBLE) + ((s_suppkey * 7919) % 1900) / 100.0E0 AS cx",
        "CAST(10.5E0 AS DOUBLE) + ((s_suppkey * 104729) % 1900) / 100.0E0 AS cy"]),
    "points": ("customer", [
        "c_custkey AS location_id", "'Place ' || CAST(c_custkey AS STRING) AS station_name",
        "CAST(69.8E0 AS DOUBLE) + ((c_custkey * 7919) % 20471) * 0.001E0 AS lon",
        "CAST(9.8E0 AS DOUBLE) + ((c_custkey * 15485863) % 20411) * 0.001E0 AS lat"]),
    "requests": ("documents", [
        "doc_id", "'m' || CAST(doc_id % 3 AS STRING) AS model", "'v1' AS prompt_version",
        "'generate' AS endpoint", "lang", "text"]),
}
SHAPES["raw_again"] = ("events", [
    e if not e.endswith(" AS line") else "event_id + 1000000000 AS line" for e in [
        x if not x.endswith("END AS value") else "CAST(value + 1 AS STRING) AS value"
        for x in SHAPES["raw_once"][1]]])
# the same monitors by number, their times moved so that they span two months
SHAPES["sent"] = ("events", ["CASE WHEN user_id % 2 = 0 THEN user_id % 4 ELSE 100 + user_id % 40 END AS location_id",
                             *[c for c in SHAPES["monitors"][1] if not c.endswith((" AS station_id", " AS timestamp_utc"))],
                             "ts + INTERVAL 15 DAY AS timestamp_utc"])
RESENT = "event_id % 40 = 7"

RASTER = Header(69.0, 33.0, 0.4, 60, 60)
RES = 5
STATION_RES = 7


def _sql(name: str) -> str:
    table, columns = SHAPES[name]
    return f"SELECT {', '.join(columns)} FROM {table}"


def _utc(df: DataFrame) -> DataFrame:
    """Times without a zone are UTC."""
    zoneless = {c for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zoneless else c for c in df.columns])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = SHAPES[name]
    return _utc(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = (spark.read.parquet(f"{sf_dir}/events.parquet").where(RESENT).selectExpr(*SHAPES["raw_again"][1]))
    return load(spark, sf_dir, "raw_once").unionByName(_utc(again))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station with position and health."""
    return load(spark, sf_dir, "readings").groupBy("station_id").agg(
        *[F.min(c).alias(c) for c in ("station_name", "lat", "lon", "city", "state", "health")],
        F.count(F.lit(1)).alias("rows"), F.max("timestamp_utc").alias("last_seen"))


def ring(points: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(f"named_struct('lon', {x}, 'lat', {y})" for x, y in points) + ")"


STATE_RING = [("x0", "y0"), ("x0 + 4", "y0"), ("x0 + 4", "y0 + 4"), ("x0", "y0 + 4"), ("x0", "y0")]
HOLE_RING = [("x0 + 1.5E0", "y0 + 1.5E0"), ("x0 + 2.5E0", "y0 + 1.5E0"), ("x0 + 2.5E0", "y0 + 2.5E0"),
             ("x0 + 1.5E0", "y0 + 2.5E0"), ("x0 + 1.5E0", "y0 + 1.5E0")]
DISTRICT_RING = [("cx + 0.9E0", "cy"), ("cx", "cy + 0.9E0"), ("cx - 0.9E0", "cy"), ("cx", "cy - 0.9E0"),
                 ("cx + 0.9E0", "cy")]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = f"CASE WHEN holed THEN array({ring(STATE_RING)}, {ring(HOLE_RING)}) ELSE array({ring(STATE_RING)}) END"
    return load(spark, sf_dir, "states_box").selectExpr("ord", "name", f"{rings} AS rings")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "districts_box").selectExpr(
        "ord", "name", f"array({ring(DISTRICT_RING)}) AS rings")
