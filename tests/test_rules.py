"""Small inline frames for the rules that are easy to get wrong."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions import geo, scales
from skyhive.operators import bootstrap, clean, fires, live, packs, photos, predict, raster, regions, replay, replies, rollup, runs, stations, validate
from skyhive.operators.neighbours import nearest_sites, neighbour_features
from skyhive.operators.scale import exact_quantiles, latest, salted_join


def one(spark, expr, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(expr.alias("v")).first().v


def test_category_edges_differ_by_rule(spark):
    rows = spark.createDataFrame([(30.0,), (60.0,), (250.0,), (250.1,), (None,)], "v double")
    got = rows.select(scales.pm25_label("v").alias("a"), scales.pm25_class("v").alias("b")).collect()
    assert [r.a for r in got] == ["Good", "Satisfactory", "Very poor", "Severe", None]
    assert [r.b for r in got] == [1, 2, 5, 5, None]


def test_distance_bands_include_their_lower_edge(spark):
    rows = spark.createDataFrame([(19.999,), (20.0,), (50.0,), (100.0,), (None,)], "v double")
    got = [r.b for r in rows.select(scales.distance_band("v").alias("b")).collect()]
    assert got == ["0-20 km", "20-50 km", "50-100 km", "100 km+", "no remaining data"]


def test_units_and_names(spark):
    assert one(spark, C.unit_name(F.col("u")), u=" µg/m³ ") == "ug/m3"
    assert one(spark, C.unit_name(F.col("u")), u="°C") == "degC"
    assert one(spark, C.unit_name(F.col("u")), u="PPB") == "ppb"
    assert one(spark, C.match_key(F.col("u")), u="Tamil Nādu ") == "tamilnadu"
    assert one(spark, C.station_slug(F.col("u"), F.lit("B c"), F.lit("(X)-1")), u="A") == "a|b-c|-x-1"
    assert one(spark, C.number(F.col("u")), u="NA") is None
    assert one(spark, C.iso_utc(F.col("u")), u="2024-01-01T05:30:00+05:30") == dt.datetime(2024, 1, 1)
    assert one(spark, C.ist_text_utc(F.col("u")), u="13-09-2026 14:00:00") == dt.datetime(2026, 9, 13, 8, 30)


def test_wind(spark):
    assert one(spark, C.wind_sin(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, C.compass_from(F.lit(0.0), F.lit(-1.0))) == "N (0°)"
    assert one(spark, C.compass_from(F.lit(-3.0), F.lit(0.0))) == "E (90°)"
    east, north = F.lit(10.0), F.lit(0.0)
    assert one(spark, fires.upwind_weight(east, north, F.lit(10.0), "u", "v"), u=0.49, v=0.0) == 0.5
    assert one(spark, fires.upwind_weight(east, north, F.lit(10.0), "u", "v"), u=0.5, v=0.0) == pytest.approx(1.0)
    assert one(spark, fires.upwind_weight(east, north, F.lit(10.0), "u", "v"), u=-2.0, v=0.0) == 0.0
    gap = spark.range(1).select(F.lit(None).cast("double").alias("u"), F.lit(1.0).alias("v"))
    assert gap.select(fires.upwind_weight(east, north, F.lit(10.0), "u", "v").alias("w")).first().w is None


def record(line, value, when="2024-01-01T00:00:00+00:00", sensor=1, parameter="pm25", unit="ug/m3", lat="20", state="S"):
    return (7, sensor, "Site", when, lat, "75", parameter, unit, value, state, line)


RAW = "location_id bigint, sensors_id bigint, location string, datetime string, lat string, lon string, parameter string, units string, value string, state string, line bigint"


def test_each_row_drops_once_and_the_ledger_balances(spark):
    rows = [record(1, "NA", when="bad"), record(2, "5", when="bad"), record(3, "5", lat=None), record(4, "-1"),
            record(5, "999"), record(6, "2000.5"), record(7, "2000"), record(8, "26", parameter="wind_speed", unit="m/s"),
            record(9, "25", parameter="wind_speed", unit="m/s", sensor=2), record(10, "6"), record(11, "9999999", parameter="odd", sensor=3)]
    judged = clean.judge(clean.normalise(spark.createDataFrame(rows, RAW)))
    got = {r.line: r.drop_reason for r in judged.collect()}
    assert got == {1: "null_value", 2: "bad_timestamp", 3: "missing_coordinates", 4: "negative", 5: "sentinel_999",
                   6: "implausible_high", 7: None, 8: "wind_speed_over_25ms", 9: None, 10: None, 11: None}
    counts = clean.drop_counts(judged, ["line"])
    assert counts.agg(F.sum("rows")).first()[0] == len(rows)
    by_reason = {r.drop_reason: r.rows for r in counts.groupBy("drop_reason").agg(F.sum("rows").alias("rows")).collect()}
    assert by_reason["duplicate_sensor_timestamp"] == 1 and by_reason["kept"] == 3
    kept = clean.survivors(judged, ["line"]).where("sensors_id = 1").collect()
    assert [r.line for r in kept] == [10]
    again = clean.refilter(clean.clean(spark.createDataFrame(rows, RAW)))
    assert again.where("drop_reason IS NOT NULL").count() == 0


def flagged(spark, samples):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", "pm25", v, start + dt.timedelta(seconds=sec), i) for i, (sec, v) in enumerate(samples)]
    df = spark.createDataFrame(rows, "station_id string, parameter string, value double, timestamp_utc timestamp, line int")
    out = runs.flag_quality(df, ["line"])
    return [r.quality_flag for r in out.orderBy("line").collect()]


def test_flat_run_needs_23_hours_and_survives_midnight(spark):
    hour = 3600
    assert set(flagged(spark, [(h * hour, 5.0) for h in range(24)])) == {"stuck_run"}
    short = [(h * hour, 5.0) for h in range(23)] + [(22 * hour + 59 * 60, 5.0)]
    assert set(flagged(spark, short)) == {"ok"}
    over_midnight = [((12 + h) * hour, 5.0) for h in range(40)]
    assert set(flagged(spark, over_midnight)) == {"stuck_run"}


def test_flat_run_breaks_after_61_minutes(spark):
    step = 61 * 60
    assert set(flagged(spark, [(i * step, 5.0) for i in range(30)])) == {"stuck_run"}
    assert set(flagged(spark, [(i * (step + 1), 5.0) for i in range(30)])) == {"ok"}


def test_placeholder_wins_and_other_parameters_are_unchecked(spark):
    got = flagged(spark, [(h * 3600, 985.0) for h in range(30)])
    assert set(got) == {"stuck_placeholder"}
    df = spark.createDataFrame([("s", "no2", 1.0, dt.datetime(2024, 1, 1), 0)],
                               "station_id string, parameter string, value double, timestamp_utc timestamp, line int")
    assert runs.flag_quality(df, ["line"]).first().quality_flag == "unchecked"


def test_runs_match_brute_force(spark):
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(1500):
        t += rng.choice([600, 1800, 3600, 3660, 3661, 9000])
        rows.append((f"s{rng.randint(0, 1)}", float(rng.randint(0, 1)), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, value double, ts timestamp, line int")
    got = {r.line: (r.run_start, r.run_end) for r in runs.with_runs(df, ["k"], "ts", "value", ["line"]).collect()}
    want = {}
    for k in ("s0", "s1"):
        run = []
        for r in [r for r in rows if r[0] == k] + [None]:
            if run and (r is None or r[1] != run[-1][1] or (r[2] - run[-1][2]).total_seconds() > 3660):
                want.update({x[3]: (run[0][2], run[-1][2]) for x in run})
                run = []
            if r:
                run.append(r)
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 100) for _ in range(999)], "b": [1.0] * 500 + [-2.0] * 3, "c": [7.0], "d": [0.0, 0.0, 5e-9]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    probs = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    for row in exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.percentile(values[row.k], 100 * p)), abs=1e-12)


def test_latest_and_salted_join(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, o int, v string")
    assert {(r.k, r.v, r.copies) for r in latest(df, ["k"], ["o"]).collect()} == {(1, "c", 3), (2, "z", 1)}
    small = spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string")
    assert salted_join(df, small, ["k"], F.col("o")).count() == 3
    assert salted_join(df, small, ["k"], F.col("o"), "left").where("w IS NULL").count() == 1
    with pytest.raises(ValueError):
        salted_join(df, small, ["k"], F.col("o"), "right")


def kilometres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_KM * math.asin(math.sqrt(min(1, h)))


def test_nearest_sites_match_brute_force_around_the_globe(spark):
    rng = random.Random(1)
    sites = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)]
    sites += [(1000 + i, 28 + rng.gauss(0, .1), 77 + rng.gauss(0, .1)) for i in range(150)]
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    spots += [(1000 + i, 28 + rng.gauss(0, .2), 77 + rng.gauss(0, .2)) for i in range(40)]
    s = spark.createDataFrame(sites, "site long, lat double, lon double")
    t = spark.createDataFrame(spots, "target long, lat double, lon double")
    got = {}
    for r in nearest_sites(t, s, 7).collect():
        got.setdefault(r.target, []).append((r.km, r.site))
    for key, lat, lon in spots:
        want = sorted((kilometres(lat, lon, a, b), k) for k, a, b in sites)[:7]
        assert [k for _, k in sorted(got[key])] == [k for _, k in want]


def test_a_crowd_in_reach_is_not_compared_site_by_site(spark):
    from skyhive.operators.neighbours import _at_levels, _searched

    rng = random.Random(7)
    sites = [(i, 20 + rng.random() / 2, 75 + rng.random() / 2) for i in range(3000)] + [(5000, 25.0, 80.0), (5001, 24.0, 70.0)]
    spots = [(i, 18 + 4 * rng.random(), 73 + 4 * rng.random()) for i in range(200)]
    s, t = spark.createDataFrame(sites, "site long, lat double, lon double"), spark.createDataFrame(spots, "target long, lat double, lon double")
    searched, levels = _searched(t, s, [], 3)
    pairs = (_at_levels(t, levels, "ty", "tx").join(searched, ["level", "ty", "tx"])
             .join(_at_levels(s, levels, "sy", "sx").select("level", "sy", "sx", "site"), ["level", "sy", "sx"]).count())
    assert pairs <= 200 * (4 * 3 + 16)
    got = {}
    for r in nearest_sites(t, s, 3).collect():
        got.setdefault(r.target, []).append((r.km, r.site))
    for key, lat, lon in spots:
        assert [k for _, k in sorted(got[key])] == [k for _, k in sorted((kilometres(lat, lon, a, b), k) for k, a, b in sites)[:3]]


def test_neighbours_never_see_their_own_cell_and_fall_back_exactly(spark):
    rng = random.Random(5)
    stations_ = [(f"s{i:03d}", 20 + rng.random() * 3, 75 + rng.random() * 3) for i in range(120)] + [("twin-a", 21.0, 76.0), ("twin-b", 21.0, 76.0)]
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    rows = []
    for name, lat, lon in stations_:
        for day in days:
            # on the second day only far stations report, beyond every short list
            if day == days[1] and not (lat > 22.6 or name.startswith("twin")):
                continue
            rows.append((name, lat, lon, day, rng.random() * 100))
    df = spark.createDataFrame(rows, "station_id string, lat double, lon double, period date, value double")
    placed = (df.withColumn("cell", geo.cell_of("lat", "lon", 7)).withColumn("cell_lat", geo.centroid_lat("cell", 7))
              .withColumn("cell_lon", geo.centroid_lon("cell", 7)))
    table = placed.collect()
    got = {(r.cell, r.period): r for r in neighbour_features(placed, placed, k=3).collect()}
    for q in table:
        near = sorted((round(kilometres(q.cell_lat, q.cell_lon, o.cell_lat, o.cell_lon), 6), o.station_id, o.value)
                      for o in table if o.period == q.period and o.cell != q.cell)[:3]
        r = got[(q.cell, q.period)]
        w = [1 / max(km, 0.5) ** 2 for km, _, _ in near]
        assert r.neighbour_idw == pytest.approx(sum(a * v for a, (_, _, v) in zip(w, near)) / sum(w), rel=1e-6)
        assert r.neighbour_nearest == near[0][2]
        assert r.n_reporting == sum(o.period == q.period and o.cell != q.cell for o in table)


def test_lattice(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(8, 36), rng.uniform(68, 97)) for _ in range(300)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", geo.cell_of("lat", "lon", 7))
    again = df.select("cell", geo.cell_of(geo.centroid_lat("cell"), geo.centroid_lon("cell"), 7).alias("back"),
                      geo.parent("cell", 5).alias("p"), geo.cell_level("cell").alias("level"),
                      geo.haversine_km("lat", "lon", geo.centroid_lat("cell"), geo.centroid_lon("cell")).alias("km")).collect()
    assert all(r.cell == r.back and r.level == 7 for r in again)
    assert max(r.km for r in again) < 2.0
    assert len({r.p for r in again}) <= len({r.cell for r in again})


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def test_polygons_holes_snapping_and_first_wins(spark):
    square = ring([(70, 10), (74, 10), (74, 14), (70, 14), (70, 10)])
    hole = ring([(71, 11), (72, 11), (72, 12), (71, 12), (71, 11)])
    beside = ring([(74, 10), (78, 10), (78, 14), (74, 14), (74, 10)])
    over = ring([(73, 10), (75, 10), (75, 14), (73, 14), (73, 10)])
    schema = "ord int, name string, rings array<array<struct<lon:double,lat:double>>>"
    polygons = spark.createDataFrame([(0, "A", [square, hole]), (1, "B", [beside]), (2, "C", [over])], schema)
    points = spark.createDataFrame([(1, 70.5, 10.5), (2, 71.5, 11.5), (3, 76.0, 12.0), (4, 73.5, 12.0), (5, 69.96, 12.0),
                                    (6, 69.94, 12.0), (7, 71.03, 11.5)], "id int, lon double, lat double")
    got = {r.id: r.region for r in regions.assign(points, polygons, "id").collect()}
    assert got == {1: "A", 2: None, 3: "B", 4: "A", 5: "A", 6: None, 7: "A"}


def test_radius_sums_match_brute_force(spark):
    rng = random.Random(4)
    day = dt.date(2024, 1, 1)
    targets = [(i, rng.uniform(60, 70), rng.uniform(20, 40)) for i in range(40)]
    sources = [(day, rng.randint(1, 5), rng.random() * 9, rng.uniform(60, 70), rng.uniform(20, 40)) for _ in range(200)]
    t = spark.createDataFrame(targets, "region_cell int, lat double, lon double")
    s = spark.createDataFrame(sources, "date date, n int, frp double, lat double, lon double")
    wind = t.select("region_cell", F.lit(day).alias("date"), F.lit(3.0).alias("u10"), F.lit(1.0).alias("v10"))
    got = {r.region_cell: r for r in fires.radius_sums(t, s, wind).collect()}
    for key, lat, lon in targets:
        n = up = 0.0
        for _, count, _, la, lo in sources:
            dx, dy = (lon - lo) * 111.32 * math.cos(math.radians(lat)), (lat - la) * 110.57
            dist = math.hypot(dx, dy)
            if dist <= 150:
                n += count
                up += count * max(0.0, (dx * 3 + dy) / (max(dist, 1e-6) * math.hypot(3, 1)))
        assert (key in got) == (n > 0)
        if n:
            assert got[key].fires_150km == n and got[key].upwind_fires_150km == pytest.approx(up)


def test_raster_edges(spark):
    header = raster.Header(70.0, 20.0, 0.5, 2, 2)
    points = spark.createDataFrame([("in", 19.75, 70.25), ("north", 20.1, 70.25), ("east", 19.75, 71.0), ("west", 19.75, 69.9)],
                                   "p string, lat double, lon double")
    pixels = raster.pixel_table(spark.createDataFrame([(dt.date(2024, 1, 1), 0, 0, 4.0), (dt.date(2024, 1, 1), 0, 1, -9999.0)],
                                                      "date date, row int, col int, aai double"), ["aai"])
    got = {r.p: r.aai for r in raster.sample(points, pixels, header, ["aai"]).collect()}
    assert got == {"in": 4.0, "north": None, "east": None, "west": None}


def test_live_ties_and_validity(spark):
    rows = [("s", "c", "n", "1", "2", "13-09-2026 14:00:00", p, v, i) for i, (p, v) in enumerate(
        [("PM10", "80"), ("NO2", "80"), ("CO", "NA"), ("OZONE", "10")])]
    df = spark.createDataFrame(rows, "state string, city string, station string, latitude string, longitude string,"
                                     " last_update string, pollutant_id string, avg_value string, line int")
    r = live.live_table(live.live_readings(df, ["line"]), ["line"]).first()
    assert (r.n_pollutants, r.aqi, r.dominant_pollutant, r.aqi_valid, r.aqi_category) == (3, 80.0, "pm10", True, "Satisfactory")
    only = live.live_table(live.live_readings(df.where("pollutant_id = 'NO2'"), ["line"]), ["line"]).first()
    assert only.aqi == 80.0 and only.aqi_valid is False


def test_photo_bands_and_fusion(spark):
    # Published readings
    rows = [("a", True, 85, 0.3, 0.75), ("b", True, 45, 4.5, 0.85), ("c", False, 0, 0.0, 0.0), ("d", True, 30, 1.5, 0.8)]
    df = spark.createDataFrame(rows, "id string, sky_visible boolean, haze_severity int, visibility_km_estimate double, confidence double")
    got = {r.id: r for r in photos.observations(df).collect()}
    assert (got["a"].pm25_low, got["a"].pm25_high, got["a"].effective_confidence) == (251, 400, 0.75)
    assert (got["b"].pm25_low, got["b"].pm25_high) == (61, 120)
    assert got["c"].status == "no_sky" and got["c"].pm25_low is None and got["c"].effective_confidence == 0.0
    assert got["d"].consistency_warning and got["d"].effective_confidence == 0.16
    fused = spark.range(1).select(scales.fuse(F.lit(173.0), F.lit(173 * 0.309), F.lit(251), F.lit(400), F.lit(0.85)).alias("f")).first().f
    assert round(fused.fused) == 214 and round(fused.photo_weight, 2) == 0.27


def test_published_confidence_levels_and_decision(spark):
    # Published band results of the promoted and the combined model
    rows = [("promoted", "0-20 km", 30.856, 95684, -5.836), ("promoted", "20-50 km", 37.916, 18474, 6.758),
            ("promoted", "50-100 km", 37.787, 23396, 1.534), ("promoted", "100 km+", 59.249, 5033, -19.551),
            ("combined", "20-50 km", 37.916, 18474, 6.758), ("combined", "100 km+", 51.314, 5033, -7.671)]
    df = spark.createDataFrame(rows, "model string, band string, nmae_pct double, station_days long, vs_idw_lo double")
    levels = {r.label: r.rel_error_pct for r in bootstrap.confidence_levels(df, "promoted").collect()}
    assert levels == {"high": 30.9, "medium": 37.8, "low": 59.2}
    verdict = bootstrap.decide(df, "combined", "promoted").first()
    assert (verdict.wins, verdict.promoted) == (False, "promoted")
    assert bootstrap.decide(df.withColumn("vs_idw_lo", F.lit(1.0)), "combined", "promoted").first().wins


def test_routing_sends_unknown_distance_far(spark):
    rows = [("s", m, dt.date(2024, 1, d), km, "b", 1.0, p) for d, km in ((1, 100.0), (2, 100.1), (3, None)) for m, p in (("near", 1.0), ("far", 2.0))]
    df = spark.createDataFrame(rows, "station_id string, model string, period date, nearest_reporting_km double, band string, actual double, predicted double")
    got = {r.period.day: r.predicted for r in bootstrap.combine(df, "near", "far").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0}


def test_replies(spark):
    fence = "```json\n{\"a\": 1}\n```"
    df = spark.createDataFrame([(1, fence), (2, "{\"a\": 2}"), (3, "{\"b\": 2}"), (4, "no"), (5, "[1]")], "id int, reply string")
    got = {r.id: (r.status, r.data.a if r.data else None) for r in replies.parsed(df, "reply", "a int", ["a"]).collect()}
    assert got == {1: ("ok", 1), 2: ("ok", 2), 3: ("unparseable", None), 4: ("unparseable", None), 5: ("unparseable", None)}


def test_auto_resolution_and_boxes(spark):
    ask = lambda n: one(spark, rollup.auto_resolution(F.lit(n), 7))
    assert (ask(60000), ask(60001), ask(420001), ask(10**9)) == (7, 6, 5, 4)
    with pytest.raises(ValueError):
        geo.within_box("lat", "lon", 2, 0, 1, 1)


def test_daily_means_use_indian_days_and_enough_hours(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 18, 20), 1.0), ("s", dt.datetime(2024, 1, 1, 18, 40), 3.0), ("s", dt.datetime(2024, 1, 1, 19, 0), 8.0)]
    df = spark.createDataFrame(rows, "station_id string, timestamp_utc timestamp, value double")
    daily = stations.daily_means(stations.hourly_means(df), 1).collect()
    assert sorted((r.period, r.value) for r in daily) == [(dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 2), 8.0)]
    assert stations.daily_means(stations.hourly_means(df), 2).count() == 0


def test_missing_days(spark):
    seen = spark.createDataFrame([(dt.date(2024, 1, 2),)], "date date")
    got = sorted(r.date.day for r in validate.missing_days(seen, dt.date(2024, 1, 1), dt.date(2024, 1, 3)).collect())
    assert got == [1, 3]


def test_unknown_stays_unknown(spark):
    none = F.lit(None).cast("double")
    assert one(spark, geo.haversine_km(none, F.lit(77.0), F.lit(20.0), F.lit(77.0))) is None
    assert one(spark, geo.chord_km(none)) is None
    assert one(spark, scales.distance_band(geo.chord_km(none))) == "no remaining data"
    assert one(spark, scales.haze_range(F.lit(None).cast("int"))) is None
    assert one(spark, scales.photo_weight(F.lit(True), none, F.lit(5.0), F.lit(80))) is None
    assert one(spark, scales.fuse(F.lit(100.0), none, F.lit(61), F.lit(120), F.lit(0.8))) == (None, None, None)
    assert one(spark, scales.fuse(F.lit(100.0), F.lit(9.0), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.8))) == (100.0, None, 0.0)
    levels = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0)], "level int, rel_error_pct double")
    rows = spark.createDataFrame([(None, 5.0), (-3.0, 5.0)], "estimate double, dist_nearest_km double")
    got = {(r.estimate, r.pm25, r.uncertainty) for r in predict.with_confidence(rows, levels).collect()}
    assert got == {(None, None, None), (-3.0, 0.0, 0.0)}


def test_cells_without_estimate_are_not_the_worst(spark):
    rows = spark.createDataFrame([("2024-01-01", 1, 20.0, 77.0, None, 2, 80.0, 80.0), ("2024-01-01", 2, 25.0, 80.0, 50.0, 2, 80.0, 80.0)],
                                 "date string, cell long, lat double, lon double, pm25 double, confidence int, dist_working_km double, dist_nearest_km double")
    assert [r.cell for r in packs.select_cells(rows, 5, centres={}).collect()] == [2]


def test_request_keys_do_not_collide(spark):
    rows = spark.createDataFrame([("a|b", "c", "x"), ("a", "b|c", "x"), (None, "a|b|c", "x"), ("a", "b", "c|x")], "m string, p string, e string")
    assert rows.select(replay.request_key("m", "p", "e").alias("k")).distinct().count() == 4


def test_only_plain_numbers_count(spark):
    texts = ["5D", "12.5f", "0x1p3", "NaN", "Infinity", "1e400", "", None, " -12.50 ", ".5", "7.", "+3e2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.number("t").alias("v")).collect()
    assert [r.v for r in rows] == [None] * 8 + [-12.5, 0.5, 7.0, 300.0]


def test_names_fold_as_compatibility_decomposition(spark):
    import unicodedata

    texts = ["ﬁrozabad ĳ Ａgra", "½ ㎏ №5 Ⅷ", "Thēni ⓐ", "दिल्ली Delhi", "ß straße", "𝒳𝟙"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.fold_ascii("t").alias("v")).collect()
    assert [r.v for r in rows] == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().strip() for t in texts]


def test_batch_results_take_the_last_and_keep_the_batch_status(spark):
    asked = spark.createDataFrame([("b", "h1", "ok"), ("b", "h2", "ok"), ("b", "h3", "ok"), ("c", "h1", "unparseable")], "batch string, item string, batch_status string")
    results = spark.createDataFrame([("b", "h1", 0, ("old",), ["source"]), ("b", "h1", 1, ("new",), ["source"]), ("b", "h2", 2, (None,), ["source"]),
                                     ("b", "h3", 3, ("x",), ["other"])], "batch string, item string, position int, result struct<source:string>, keys array<string>")
    got = {(r.batch, r.item): (r.status, r.result and r.result.source) for r in replies.match_batch(asked, results, "batch", "item", ["source"]).collect()}
    assert got == {("b", "h1"): ("ok", "new"), ("b", "h2"): ("ok", None), ("b", "h3"): ("missing_from_batch", None), ("c", "h1"): ("unparseable", None)}


def test_bootstrap_picks_are_dealt_out_and_looked_up(spark):
    rows = [(f"s{i}", dt.date(2024, 1, 1 + d), "0-20 km", float(i), i + 1.0, i + 2.0) for i in range(40) for d in range(3)]
    wide = spark.createDataFrame(rows, "station_id string, period date, band string, actual double, idw_k8 double, nearest_station double")
    picks, _ = bootstrap.station_draws(wide.select("station_id").distinct(), 50, 0)
    assert picks.count() == 40 * 50
    assert picks.select(F.spark_partition_id()).distinct().count() > 1
    out = bootstrap.station_bootstrap(wide, ["idw_k8", "nearest_station"], 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the picks, many times the stations, are never the side that is held in memory or broadcast
    assert "ShuffledHashJoin [pos" in plan and not [x for x in plan.split("\n") if "BroadcastHashJoin [pos" in x]
    assert {(r.model, r.stations, r.station_days, r.mae) for r in out.collect()} == {("idw_k8", 40, 120, 1.0), ("nearest_station", 40, 120, 2.0)}


def test_centroids_on_a_border_of_the_coarser_lattice_are_decided_exactly(spark):
    import duckdb

    from skyhive.registry.sqltext import parent_exact

    qs, rs = range(100, 130), range(-60, -30)
    rows = [(q, r) for q in qs for r in rs]
    cells = spark.createDataFrame(rows, "q long, r long").withColumn("cell", geo.pack(F.lit(7), F.col("q"), F.col("r")))
    got = {(x.q, x.r): (x.p, x.odd) for x in cells.select("q", "r", geo.parent_exact("cell", 5, 7).alias("p"), geo.parent_exact("cell", 6, 7).alias("odd")).collect()}

    def held(q, r, m=7):
        """The rule of cell_of in whole numbers: sevenths of a side."""
        near = lambda v: (2 * v + m) // (2 * m)
        a, b, c = near(q), near(r), near(-q - r)
        da, db, dc = abs(m * a - q), abs(m * b - r), abs(m * c + q + r)
        if da > db and da > dc:
            a = -b - c
        elif db > dc:
            b = -a - c
        return (5 << 56) + ((a + geo.AXIS_OFFSET) << 28) + b + geo.AXIS_OFFSET

    assert {k: v[0] for k, v in got.items()} == {k: held(*k) for k in rows}
    ids = [((7 << 56) + ((q + geo.AXIS_OFFSET) << 28) + r + geo.AXIS_OFFSET, q, r) for q, r in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (cell BIGINT, q BIGINT, r BIGINT)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", ids)
    said = con.execute(f"SELECT q, r, {parent_exact('cell', 7, 5)}, {parent_exact('cell', 7, 6)} FROM c").fetchall()
    assert {(q, r): (p, odd) for q, r, p, odd in said} == got


def test_sql_of_filed_health_counts_a_sensor_and_time_once():
    import duckdb

    from skyhive import registry
    from skyhive.registry.sqltext import FRAGMENTS

    assert "filed_station_health" in registry.all_oracles()

    con = duckdb.connect()
    con.execute("CREATE TABLE sent AS SELECT * FROM (VALUES (1, 'n', 1.0, 2.0, 'c', 's', 'pm25', 5.0, TIMESTAMP '2024-01-20 00:00:00', 1),"
                " (1, 'n', 1.0, 2.0, 'c', 's', 'pm25', 6.0, TIMESTAMP '2024-01-20 00:00:00', 2), (1, 'n', 1.0, 2.0, 'c', 's', 'pm10', 7.0, TIMESTAMP '2024-01-20 00:00:00', 3))"
                " t(location_id, station_name, lat, lon, city, state, parameter, value, timestamp_utc, line)")
    rows = con.execute(f"SELECT parameter, value FROM ({FRAGMENTS['sent_rows'][0]}) ORDER BY parameter").fetchall()
    assert rows == [("pm10", 7.0), ("pm25", 6.0)]


def test_block_bootstrap_matches_drawn_days_and_no_pick_is_a_row(spark):
    import hashlib

    rng = random.Random(4)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), rng.uniform(5, 90), rng.uniform(5, 90), rng.uniform(5, 90)) for s, n in (("a", 17), ("b", 3), ("c", 7)) for d in range(n)]
    df = spark.createDataFrame(rows, "station_id string, period date, actual double, idw_k8 double, m double")
    out = bootstrap.block_bootstrap(df, ["idw_k8", "m"], draws=40)
    assert "Generate explode(sequence" not in out._jdf.queryExecution().analyzed().toString()
    for r in out.collect():
        days = [x for x in rows if x[0] == r.station_id]
        n, at, maes, gains = len(days), 3 if r.model == "idw_k8" else 4, [], []
        for draw in range(40):
            drawn = []
            for block in range(-(-n // 7)):
                start = int(hashlib.md5(f"0|{draw}|{block}".encode()).hexdigest()[:7], 16) % (max(n - 7, 0) + 1)
                drawn += [days[start + step] for step in range(7) if block * 7 + step < n]
            error = lambda i: sum(abs(x[i] - x[2]) for x in drawn) / n
            maes.append(error(at))
            gains.append(100 * (error(3) - error(at)) / error(3))

        def cut(values, share):
            values, pos = sorted(values), share * (len(values) - 1)
            low = math.floor(pos)
            return values[low] + (values[math.ceil(pos)] - values[low]) * (pos - low)

        assert (r.days, r.mae_lo, r.mae_hi) == (n, pytest.approx(cut(maes, 0.025)), pytest.approx(cut(maes, 0.975)))
        assert (r.vs_idw_lo is None) == (r.model == "idw_k8")
        if r.model == "m":
            assert (r.vs_idw_lo, r.vs_idw_hi) == (pytest.approx(cut(gains, 0.025)), pytest.approx(cut(gains, 0.975)))


def test_points_meet_polygons_up_to_the_first_that_covers_their_tile(spark):
    rng = random.Random(9)

    def diamond(k):
        cx, cy = rng.uniform(70, 72), rng.uniform(20, 22)
        return (k, f"d{k}", [[(cx + 0.9, cy), (cx, cy + 0.9), (cx - 0.9, cy), (cx, cy - 0.9), (cx + 0.9, cy)]])

    shapes = [diamond(k) for k in range(300)]
    polygons = spark.createDataFrame(shapes, "ord long, name string, rings array<array<struct<lon:double,lat:double>>>")
    spots = [(i, rng.uniform(68.5, 73.5), rng.uniform(18.5, 23.5)) for i in range(400)]
    points = spark.createDataFrame(spots, "id long, lon double, lat double")
    got = {r.id: r.region for r in regions.assign(points, polygons, "id").collect()}

    def region(x, y):
        for _, name, ((east, top, *_),) in shapes:
            if abs(x - top[0]) + abs(y - east[1]) < 0.9:
                return name

    for i, x, y in spots:
        if region(x, y) or got[i] is None:
            assert got[i] == region(x, y)
        else:  # snapped to an edge in reach
            east, top = shapes[int(got[i][1:])][2][0][:2]
            assert 0 <= (abs(x - top[0]) + abs(y - east[1]) - 0.9) <= 0.05 * math.sqrt(2) + 1e-9
    crowd = lambda t: t.where("tx = 142 and ty = 42").count()
    assert 0 < crowd(regions.deciding_tiles(polygons)) < crowd(regions.tiles(polygons, regions.SNAP_DEG, regions.ASSIGN_DEG)) / 3


def test_cells_of_many_polygons_are_laid_by_many_tasks(spark):
    from skyhive.operators.grid import FILL_PARTS, fill

    ring = "array(array(named_struct('lon', x, 'lat', 20D), named_struct('lon', x + 1, 'lat', 20D), named_struct('lon', x + 1, 'lat', 21D), named_struct('lon', x, 'lat', 20D)))"
    polygons = spark.range(40).selectExpr("id AS ord", "'p' || id AS name", "75 + id * 0.01D AS x").selectExpr("ord", "name", f"{ring} AS rings")
    cells = fill(polygons, 5, "name")
    assert "REPARTITION_BY_NUM" in cells._jdf.queryExecution().toString() and FILL_PARTS > 1
    assert cells.count() == cells.select("cell").distinct().count() > 0


def test_detections_are_reduced_once(spark):
    rows = spark.createDataFrame([(20.0, 75.0, dt.date(2024, 1, 1), 600, "h", "A_SP", 0, 5.0, 1), (20.0, 75.0, dt.date(2024, 1, 1), 600, "h", "A_SP", 0, 7.0, 2)],
                                 "latitude double, longitude double, acq_date date, acq_time int, confidence string, source string, type int, frp double, line int")
    judged = fires.judge_fires(rows, ["line"])
    assert "min_by" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.frp, r.copies, r.drop_reason) for r in judged.collect()] == [(5.0, 2, None)]


def test_cell_days_reduce_detections_once_and_sum_for_station_cells_only(spark, monkeypatch):
    from skyhive.functions import geo
    from skyhive.operators import fires
    from skyhive.registry import signals

    calls, targets = [], []
    judge, sums = fires.judge_fires, fires.radius_sums
    monkeypatch.setattr(fires, "judge_fires", lambda *a, **k: calls.append(1) or judge(*a, **k))
    monkeypatch.setattr(fires, "radius_sums", lambda cells, *a, **k: targets.append(cells) or sums(cells, *a, **k))
    sf = "/root/testdata/sf0.001"
    rows = signals.cell_days(spark, sf)
    around = {r[0] for r in rows.select(geo.parent("cell", 5, 7)).distinct().collect()}
    assert len(calls) == 1 and {r.region_cell for r in targets[0].collect()} <= around
    signals.full_days(spark, sf)
    assert len(calls) == 2


def test_judged_fires_carry_the_columns_asked_for(spark):
    import datetime as dt

    from skyhive.operators import fires

    rows = spark.createDataFrame([(10.0, 70.0, dt.date(2024, 1, 2), 600, 5.0, "n", "A_SP", 0, 2, "x"), (10.0, 70.0, dt.date(2024, 1, 2), 600, 6.0, "l", "A_SP", 0, 1, "y")],
                                 "latitude double, longitude double, acq_date date, acq_time int, frp double, confidence string, source string, type int, line int, note string")
    got = fires.judge_fires(rows, ["line"], keep=["frp"])
    assert "note" not in got.columns and "line" not in got.columns
    assert [(r.frp, r.copies, r.drop_reason) for r in got.collect()] == [(6.0, 2, "low_confidence")]


def test_no_second_search_where_no_query_is_short(spark, monkeypatch):
    from skyhive.operators import neighbours

    rows = spark.range(6).select(F.concat(F.lit("s"), "id").alias("station_id"), F.lit(10.0).alias("lat"), (70 + F.col("id") / 5).alias("lon"),
                                 F.lit("2024-01-01").cast("date").alias("period"), F.col("id").cast("double").alias("value"))
    placed = neighbours.station_cells(rows, 7)
    monkeypatch.setattr(neighbours, "_second_search", lambda *a: pytest.fail("searched again for no query"))
    out = neighbour_features(placed, placed, k=2).where("n_reporting = 5 AND dist_nearest_km > 0 AND neighbour_nearest IS NOT NULL")
    assert out.count() == 6


def test_band_tables_read_periods_once(spark, tmp_path):
    from skyhive.operators import validate

    spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 7).alias("station_id"), F.when(F.col("id") % 2 == 0, "idw_k8").otherwise("m").alias("model"),
                           F.lit("0-20 km").alias("band"), F.col("id").cast("double").alias("actual"),
                           (F.col("id") + F.col("id") % 5).cast("double").alias("predicted")).write.parquet(str(tmp_path / "periods"))
    periods = spark.read.parquet(str(tmp_path / "periods"))
    full, means = validate.band_table(periods), validate.band_errors(periods)
    read = lambda df: [leaf.toString() for leaf in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        df._jdf.queryExecution().optimizedPlan().collectLeaves())]
    assert not any("actual" in leaf for leaf in read(full))  # only sums by station are read again
    assert len(read(means)) == 1
    assert sorted(means.collect()) == sorted(full.select(*means.columns).collect())


def test_served_days_and_levels_share_one_table_of_values(spark, monkeypatch):
    import threading

    from skyhive.registry import validation

    made, both = [], threading.Barrier(2, timeout=60)
    one = spark.createDataFrame([("a", 10.0, 12.0, "0-20 km")], "station_id string, neighbour_idw double, value double, band string")
    period = F.lit("2024-01-01").cast("date").alias("period")
    monkeypatch.setattr(validation, "observations", lambda *a: made.append(1) or one)
    monkeypatch.setattr(validation, "bare_days", lambda *a: {"grid": one, "rows": one})

    def hidden_features(values, k):
        both.wait()  # passes only while the other side is under way
        return values.select("station_id", period, "neighbour_idw", F.col("value").alias("actual"), "band", F.lit(1.0).alias("dist_nearest_km"))

    def serving_rows(grid, days, values, k):
        both.wait()
        return values.select(geo.pack(F.lit(5), F.lit(3).cast("bigint"), F.lit(4).cast("bigint")).alias("cell"), "neighbour_idw", F.col("value").alias("neighbour_nearest"),
                             F.lit(5.0).alias("dist_nearest_km"))

    monkeypatch.setattr(validation.V, "hidden_features", hidden_features)
    monkeypatch.setattr(validation.P, "serving_rows", serving_rows)
    row = validation.predicted_days(spark, "unused").first()
    assert made == [1] and (row.pm25, row.confidence) == (10.0, 0)
    assert row.rel_error_pct == 16.7 and row.uncertainty == pytest.approx(1.67)  # off by 2 of 12


def test_steps_side_by_side_keep_order_and_errors(spark):
    from skyhive.session import side_by_side

    assert side_by_side(spark, lambda: spark.range(3).count(), lambda: 5) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda: 1, lambda: 1 / 0)


def test_radius_pairs_cost_no_cosine(spark, tmp_path):
    day = F.lit("2024-01-02").cast("date").alias("date")
    # both sides from files, or the planner works the join out by itself
    spark.range(40).select(F.col("id").alias("region_cell"), (20 + F.col("id") / 10).alias("lat"), F.lit(75.0).alias("lon"), day,
                           (F.col("id") % 3).cast("double").alias("u10"), F.lit(1.0).alias("v10"), F.lit(2).cast("bigint").alias("n"),
                           F.lit(3.0).alias("frp")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    out = fires.radius_sums(rows.select("region_cell", "lat", "lon"), rows.select("date", "n", "frp", "lat", "lon"),
                            rows.select("region_cell", "date", "u10", "v10"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = plan[:next(i for i, line in enumerate(plan) if "Join Inner" in line) + 1]
    # the condition of the join draws its root; neither it nor what follows needs a cosine or the wind's speed again
    assert not any("COS(" in line or "HYPOT(u10" in line for line in above)
    got = {r.region_cell: r.fires_150km for r in out.collect()}
    near = lambda i: sum(abs(i - j) / 10 * geo.KM_PER_DEGREE_LAT <= 150 for j in range(40))
    assert got == {i: 2.0 * near(i) for i in range(40)}
