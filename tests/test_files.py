"""Sources and sinks on files in a private folder."""

import gzip
import json

from pyspark.sql import functions as F

from skyhive.operators import clean
from skyhive.sinks import tables
from skyhive.sources import files


def test_records_with_a_broken_file(spark, tmp_path):
    folder = tmp_path / "locationid=5" / "year=2024" / "month=01"
    folder.mkdir(parents=True)
    head = "location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n"
    with gzip.open(folder / "location-5-20240101.csv.gz", "wt") as f:
        f.write(head + '5,50,"A, B",2024-01-01T00:00:00+05:30,20.5,75.5,pm25,µg/m³,12.5\n')
    (folder / "location-5-20240102.csv.gz").write_bytes(b"not a gzip file")
    rows = files.read_records(spark, str(tmp_path), [(2024, 1)])
    got = clean.normalise(rows.drop("locationid", "year", "month", "source_file", "line")).collect()
    assert len(got) == 1 and got[0].value == 12.5 and got[0].unit == "ug/m3" and got[0].location == "A, B"
    bad = files.unreadable_files(spark, str(tmp_path), rows).collect()
    assert len(bad) == 1 and bad[0].source_file.endswith("20240102.csv.gz")


def test_files_that_break_off_are_unreadable_too(spark, tmp_path):
    folder = tmp_path / "locationid=5" / "year=2024" / "month=01"
    folder.mkdir(parents=True)
    head = b"location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n"
    rest = b"".join(b"5,50,A,2024-01-01T00:00:00+05:30,20.5,75.5,pm25,ug/m3,%d\n" % (i * 7919 % 1000003) for i in range(50000))
    whole = gzip.compress(head + rest)
    (folder / "a.csv.gz").write_bytes(whole)
    (folder / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    (folder / "c.csv.gz").write_bytes(gzip.compress(head))
    (folder / "d.csv.gz").write_bytes(gzip.compress(b""))
    rows = files.read_records(spark, str(tmp_path))
    delivered = {r.source_file.rsplit("/", 1)[1] for r in rows.select("source_file").distinct().collect()}
    bad = {r.source_file.rsplit("/", 1)[1] for r in files.unreadable_files(spark, str(tmp_path), rows).collect()}
    assert (delivered, bad) == ({"a.csv.gz"}, {"b.csv.gz", "d.csv.gz"})


def test_records_by_their_own_header_and_line_order(spark, tmp_path):
    folder = tmp_path / "locationid=5" / "year=2024" / "month=01"
    folder.mkdir(parents=True)
    names = "sensors_id,location_id,value,units,parameter,lon,lat,datetime,location,extra"
    line = '50,5,{},µg/m³,pm25,75.5,20.5,2024-01-01T00:00:00+05:30,"A ""x"", B",z'
    (folder / "location-5-20240101.csv").write_text("\ufeff" + names + "\r\n" + line.format("9.0") + "\r\n\r\n" + line.format("12.5") + "\r\n")
    (folder / "location-5-20240102.csv").write_text(names + "\n")  # a header only
    rows = files.read_records(spark, str(tmp_path), [(2024, 1)])
    got = clean.clean(rows.drop("locationid", "year", "month"), order=["source_file", "line"]).collect()
    assert [(r.location_id, r.sensors_id, r.value, r.lat, r.location) for r in got] == [(5, 50, 12.5, 20.5, 'A "x", B')]
    assert sorted(r.line for r in rows.collect()) == [1, 3]
    assert files.unreadable_files(spark, str(tmp_path), rows).count() == 0


def test_latest_complete_snapshot(spark, tmp_path):
    for name, complete in (("20240101T0000Z", True), ("20240102T0000Z", True), ("20240103T0000Z", False)):
        folder = tmp_path / name
        folder.mkdir()
        page = {"total": 1, "records": [{"state": "S", "city": "C", "station": name, "pollutant_id": "NO2", "pollutant_avg": "7",
                                         "last_update": "01-01-2024 10:00:00", "latitude": "1", "longitude": "2"}]}
        (folder / "page_000000.json").write_text(json.dumps(page))
        if complete:
            (folder / "_COMPLETE").write_text("x")
    got = files.read_live_snapshot(spark, str(tmp_path), files.latest_snapshot(spark, str(tmp_path))).collect()
    assert [r.station for r in got] == ["20240102T0000Z"]


def test_fires_with_and_without_type(spark, tmp_path):
    for name, head, line in (("A_SP", "latitude,longitude,acq_date,acq_time,confidence,frp,daynight,type", "1,2,2024-01-01,1345,n,5,D,2"),
                             ("A_NRT", "latitude,longitude,acq_date,acq_time,frp,confidence,daynight", "3,4,2024-01-02,30,6,h,N")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(head + "\n" + line + "\n")
    (tmp_path / "A_NRT" / "empty.csv").write_text("")
    got = {r.source: r for r in files.read_fires(spark, str(tmp_path)).collect()}
    assert (got["A_SP"].type, got["A_SP"].frp, got["A_SP"].acq_time) == (2, 5.0, 1345)
    assert (got["A_NRT"].type, got["A_NRT"].frp, got["A_NRT"].confidence) == (None, 6.0, "h")


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "x.csv").write_text('b,a\n"1, ""x""",2\n')
    rows = files.headed_rows(spark, str(tmp_path / "x.csv"), {"a": "int", "b": "string"})
    assert [(r.a, r.b) for r in rows.collect()] == [(2, '1, "x"')]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") <= 2  # the header and the line


def test_lines_with_and_without_quotes_give_the_same_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c,d\n1,,  x y ,\n"1",,"  x y ",\n2,"",µ\n3,z,"p, ""q""",w,extra,"more"\n4\n')
    rows = files.headed_rows(spark, str(tmp_path / "x.csv"), {"a": "int", "b": "string", "c": "string", "d": "string"})
    got = [tuple(r)[:4] for r in rows.orderBy("line").collect()]
    assert got == [(1, None, "  x y ", None), (1, None, "  x y ", None), (2, None, "µ", None), (3, "z", 'p, "q"', "w"), (4, None, None, None)]


def test_fires_are_read_in_parts(spark, tmp_path):
    (tmp_path / "A_SP").mkdir()
    lines = [f"{i % 90},2,2024-01-01,1345,n,{i % 7},D,2" for i in range(5000)]
    (tmp_path / "A_SP" / "x.csv").write_text("\ufefflatitude,longitude,acq_date,acq_time,confidence,frp,daynight,type\n\n" + "\n".join(lines) + "\n")
    (tmp_path / "A_NRT").mkdir()
    (tmp_path / "A_NRT" / "y.csv").write_text("frp,latitude\n" + "6,1\n" * 3000)
    (tmp_path / "A_NRT" / "head.csv").write_text("latitude,frp\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = files.read_fires(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"), F.sum("latitude").alias("lat")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.source, r.n, r.frp, r.lat) for r in got} == {
        ("A_SP", 5000, float(sum(i % 7 for i in range(5000))), float(sum(i % 90 for i in range(5000)))), ("A_NRT", 3000, 18000.0, 3000.0)}


def test_regions_from_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"features": [{"properties": {"shapeName": "Nādu"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
                        {"properties": {"shapeName": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(doc))
    got = files.read_regions(spark, str(tmp_path / "r.geojson")).orderBy("ord").collect()
    assert [(r.name, len(r.rings)) for r in got] == [("Nadu", 1), ("B", 3)]


def test_probe_log_keeps_the_later_line(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"location_id": 1, "years": [2023], "lat": 1.0}\n{"location_id": 1, "years": [2024], "lat": 2.0}\n')
    got = files.read_probes(spark, str(tmp_path / "p.jsonl")).collect()
    assert len(got) == 1 and got[0].lat == 2.0


def test_probe_log_is_read_in_parts(spark, tmp_path):
    lines = [json.dumps({"location_id": i % 50, "name": "x" * 200, "coords_year": i}) for i in range(4000)]
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = files.placed_lines(spark, str(tmp_path / "p.jsonl"))
        assert rows.select("block").distinct().count() > 5
        assert rows.select(F.max(F.length("value"))).first()[0] < 400
        got = {r.location_id: r.coords_year for r in files.read_probes(spark, str(tmp_path / "p.jsonl")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: 3950 + k for k in range(50)}


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("S", "pm25", "2024-01", 5.0, "ug/m3"), ("S", "no2", "2024-01", 5.0, "ug/m3"), ("T", "pm25", "2024-01", 9000.0, "ug/m3")],
                                 "state string, parameter string, month string, value double, unit string")
    tables.replace_partitions(rows, path)
    counts = tables.refilter_history(spark, path)
    assert counts.where("drop_reason = 'implausible_high'").agg(F.sum("rows")).first()[0] == 1
    left = {(r.state, r.parameter) for r in spark.read.parquet(path).collect()}
    assert left == {("S", "pm25"), ("S", "no2")}
    assert tables.refilter_history(spark, path).where("drop_reason <> 'kept'").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1234.56, 7), ("b", None, 8)], "model string, mae double, n bigint")
    assert [r.line for r in tables.markdown_rows(df).collect()] == ["| a | 1,234.6 | 7 |", "| b |  | 8 |"]


def test_monthly_features_documents_photos_and_station_sources(spark, tmp_path):
    import datetime as dt

    days = spark.createDataFrame([(1, dt.date(2024, 1, 31), 0.5), (1, dt.date(2024, 2, 1), 0.25)], "cell bigint, date date, aai double")
    path = str(tmp_path / "days")
    tables.write_cell_days(days, path)
    assert dict(spark.read.parquet(path).dtypes)["aai"] == "float"
    assert [r.aai for r in files.day_slice(spark, path, "2024-02-01", ["cell", "aai"]).collect()] == [0.25]

    docs = days.select("date", F.struct("cell", F.lit(None).cast("string").alias("note")).alias("body"))
    tables.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).where("body.cell = 1").count() == 2

    (tmp_path / "p.json").write_text(json.dumps([{"id": "a", "lat": 1.0, "credit": {"author": "x"}, "sky_visible": True, "haze_severity": 45}]))
    photo = files.read_photos(spark, str(tmp_path / "p.json")).first()
    assert (photo.id, photo.credit.author, photo.haze_severity) == ("a", "x", 45)

    index = spark.createDataFrame([(9, "N", 1.0, 2.0, "C", "S")], "location_id bigint, name string, lat double, lon double, city string, state string")
    row = files.station_source(index).first()
    assert (row.station_id, row.station_name, row.rows) == ("site-9", "N", None)
    assert files.station_source(index.drop("city")).columns[:2] == ["station_id", "station_name"]


def test_fitted_models_are_saved_and_restored(spark, tmp_path):
    from skyhive.operators import learn
    from skyhive.operators.features import FEATURES

    rows = spark.range(400).select("id", *[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(FEATURES)],
                                   ((F.col("id") * 7) % 29).cast("double").alias("actual"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 40).alias("cell"))
    fitted = learn.fit_folds(rows, 2, "residual", "squared", ["lat", "lon"], rounds=2, depth=2)
    assert "lat" not in fitted.features
    assert all(1 <= len(errors) <= 2 for errors in fitted.errors.values())  # one error for each round that ran
    learn.save(fitted, str(tmp_path / "m"))
    back = learn.restore(str(tmp_path / "m"))
    first = [r.p for r in learn.predict_mean(fitted, rows, "p").orderBy("id").collect()]
    assert first == [r.p for r in learn.predict_mean(back, rows, "p").orderBy("id").collect()]
    assert back.errors == fitted.errors


def test_boosting_ends_with_the_gain(spark):
    from skyhive.operators import learn
    from skyhive.operators.features import FEATURES

    rows = spark.range(600).select(*[(F.rand(i) * 10).alias(f) for i, f in enumerate(FEATURES)], F.rand(99).alias("actual"),
                                   (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 60).alias("cell")).cache()
    fitted = learn.fit_folds(rows, 2, "level", "squared", rounds=40, depth=3)
    for errors in fitted.errors.values():  # noise has nothing to learn
        assert len(errors) < 40
    held = {r.cell for r in learn.held_cells(rows).collect()}
    assert len(held) == 6 and held == {r.cell for r in learn.held_cells(rows.repartition(7)).collect()}


def test_routes_near_and_far_models(spark):
    from skyhive.operators import deploy, learn

    class Constant(learn.Fitted):
        pass

    def constant(fitted, rows, name):
        value = F.lit(float(fitted.features))
        return rows.withColumn(name, F.col("neighbour_idw") + value if fitted.target == "residual" else value)

    rows = spark.createDataFrame([(1, 100.0, 5.0), (2, 100.5, 5.0), (3, None, None)], "id int, dist_nearest_km double, neighbour_idw double")
    held, learn.predict_mean = learn.predict_mean, constant
    try:
        out = deploy.estimates(deploy.Deployed(Constant({}, 1, "residual"), Constant({}, 40, "level")), rows).orderBy("id").collect()
    finally:
        learn.predict_mean = held
    assert [(r.route, r.estimate) for r in out] == [("near", 6.0), ("far", 40.0), ("far", 40.0)]


def test_variants_read_rows_once_a_fold(spark, tmp_path, monkeypatch):
    from skyhive.operators import deploy, learn

    monkeypatch.setattr(learn, "_scored", lambda fitted, fold, rows, name: rows.withColumn(name, F.lit(float(fitted.models[fold]))))
    fits = {deploy.NEAR: learn.Fitted({0: 1, 1: 2, 2: 3}, [], "residual"), "other": learn.Fitted({0: 4, 1: 5, 2: 6}, [], "level"),
            deploy.FAR: learn.Fitted({0: 7, 1: 8, 2: 9}, [], "level")}
    spark.createDataFrame([("a", 0, 100.0, 10.0), ("b", 1, 100.5, 10.0), ("c", 2, None, None), ("d", None, 1.0, 20.0)],
                          "station_id string, fold int, dist_nearest_km double, neighbour_idw double").select(
        "*", F.lit("2024-01-01").cast("date").alias("period"), F.lit("0-20 km").alias("band"), F.lit(1.0).alias("actual"),
        F.col("neighbour_idw").alias("neighbour_nearest")).write.parquet(str(tmp_path / "rows"))
    out = deploy.hidden_predictions(fits, spark.read.parquet(str(tmp_path / "rows")))
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    # three variants over three folds were 27 readings of the rows, and the combined form met itself by a shuffle
    assert leaves.size() == 3 and "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.collect():
        assert got.setdefault((r.station_id, r.model), r.predicted) == r.predicted
    assert [got[s, deploy.NEAR] for s in "abcd"] == [11.0, 12.0, None, 21.0]
    assert [got[s, "other"] for s in "abcd"] == [4.0, 5.0, 6.0, 4.0]
    assert [got[s, "combined"] for s in "abcd"] == [11.0, 8.0, 9.0, 21.0] and out.count() == 4 * 6
