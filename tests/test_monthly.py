"""Monthly state merged against the same operators on all readings at once."""

import datetime as dt
import random

from skyhive.operators import monthly, runs, stations
from skyhive.session import shared_path

NAMES = "station_id string, station_name string, lat double, lon double, city string, state string, parameter string, value double, timestamp_utc timestamp, line long"


def readings(spark, seed):
    """Four months; lines that stay flat over one and over several month ends, ties of time, months without readings."""
    rng, rows = random.Random(seed), []

    def put(station, parameter, when, value):
        rows.append((station, f"N{rng.randrange(3)}", rng.choice([10.0, 10.5, None]), 70.0, rng.choice(["c", None]), f"S{ord(station[0]) % 2}", parameter, value, when, len(rows)))

    start = dt.datetime(2023, 11, 1)
    for station in "abcdefgh":
        now = start + dt.timedelta(hours=rng.randrange(900))
        while now < dt.datetime(2024, 3, 1):
            flat = {"a": now.day in (1, 29, 30, 31), "b": True, "c": now.month == 1}.get(station, rng.random() < 0.2)
            value = 985.0 if station == "d" and now.day < 3 else 7.0 if flat else float(rng.randrange(3))
            put(station, "pm10" if station in "ef" or (station == "g" and now.month == 12) else "pm25", now, value)
            if rng.random() < 0.05:
                put(station, "pm25", now, float(rng.randrange(2)))
                put(station, "pm25", now, value)
            now += dt.timedelta(minutes=rng.choice([30, 60, 61, 62 if station not in "ab" else 60])) if rng.random() < 0.97 else dt.timedelta(hours=9 if station != "b" else 1)
            if station == "h" and now.month == 12:
                now = dt.datetime(2024, 2, 1)
    put("z", "co", start, 1.0)
    return spark.createDataFrame(rows, NAMES)


def test_months_loaded_one_by_one_give_what_all_readings_give(spark):
    for seed in (1,):
        rows = readings(spark, seed).cache()
        root = shared_path(spark, "months")
        for months in (["2023-12"], ["2023-11", "2024-02"], ["2024-01"], ["2023-12"]):  # any order, one month twice
            monthly.load_months(rows, root, months, ["line"])
        assert spark.read.parquet(f"{root}/history").count() == rows.count()
        want = stations.station_health(stations.station_table(rows, ["line"]), runs.flag_quality(rows, ["line"]))
        got = monthly.health(spark, root)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert {r["health"] for r in want.collect()} >= {"stuck", "dead"}
        sums = ["station_id", "parameter", "ok", "placeholder", "runs", "ok_hours", "last_usable_utc", "usable_coverage"]
        channels = monthly.merged_channels(monthly._state(spark, root, "channels")).select(*sums).collect()
        assert sorted(channels, key=str) == sorted(stations.channel_health(runs.flag_quality(rows, ["line"])).select(*sums).collect(), key=str)
        cover = stations.coverage(stations.hourly_means(rows)).collect()
        assert sorted(monthly.coverage(spark, root).collect()) == sorted(cover)
        rows.unpersist()


def test_a_run_over_a_whole_month_joins_both_neighbours(spark):
    hours = [dt.datetime(2024, 1, 31, 20) + dt.timedelta(hours=h) for h in range(4 + 29 * 24 + 3)]
    rows = spark.createDataFrame([("a", "n", 1.0, 1.0, None, "S", "pm25", 5.0, t, i) for i, t in enumerate(hours)], NAMES)
    root = shared_path(spark, "months")
    for month in ("2024-03", "2024-01", "2024-02"):
        monthly.load_months(rows, root, [month], ["line"])
    row = monthly.merged_channels(monthly._state(spark, root, "channels")).first()
    assert (row["ok"], row["runs"], row["ok_hours"], row["last_usable_utc"]) == (0, len(hours), 0, None)


def test_no_reading_of_history_is_read_for_health(spark):
    rows = readings(spark, 3).where("station_id < 'c'")
    root = shared_path(spark, "months")
    monthly.load_months(rows, root, ["2023-12"], ["line"])
    assert not any("/history" in f for f in monthly.health(spark, root).inputFiles())


def test_nothing_to_load_leaves_the_tables_alone(spark):
    rows = readings(spark, 4).where("station_id = 'e'")
    root = shared_path(spark, "months")
    monthly.load_months(rows, root, ["2024-01"], ["line"])
    before = monthly.health(spark, root).collect()
    monthly.load_months(rows.limit(0), root, ["2024-01"], ["line"])
    assert monthly.health(spark, root).collect() == before
