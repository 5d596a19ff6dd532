"""Lattice, regions, grid, distances, rollups and box queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions import geo
from skyhive.functions.scales import distance_band, gap_bin
from skyhive.operators import grid as G
from skyhive.operators import regions as R
from skyhive.operators import rollup
from skyhive.operators.neighbours import near_by_health, nearest_sites
from skyhive.operators.packs import nearest_monitors
from skyhive.registry.adapters import RES, districts, load, sites, states
from skyhive.registry.book import register
from skyhive.session import cut_lineage
from skyhive.registry.sqltext import (band, cell_of, cell_q, cell_r, d, fixed6, fragment, haversine, lat_of, lon_of,
                                      parent, parent_exact, query)

BOX = (72.0, 12.0, 84.0, 24.0)

fragment("placed", f"SELECT location_id, station_name, lat, lon, {cell_of('lat', 'lon', 7)} AS cell FROM points", "points")


@register("cells_of_points", query(f"""SELECT location_id, cell, {cell_of('lat', 'lon', 5)} AS cell_r5,
 {cell_of('lat', 'lon', 4)} AS cell_r4 FROM placed""", "placed"))
def cells_of_points(spark, sf):
    return load(spark, sf, "points").select(
        "location_id", geo.cell_of("lat", "lon", 7).alias("cell"), geo.cell_of("lat", "lon", 5).alias("cell_r5"),
        geo.cell_of("lat", "lon", 4).alias("cell_r4"))


@register("cell_geometry", query(f"""SELECT cell, round({lat_of('cell', 7)}, 6) AS lat, round({lon_of('cell', 7)}, 6) AS lon,
 {parent_exact('cell', 7, 6)} AS cell_r6, {parent_exact('cell', 7, 5)} AS cell_r5, {parent_exact('cell', 7, 4)} AS cell_r4
 FROM (SELECT DISTINCT cell FROM placed)""", "placed"))
def cell_geometry(spark, sf):
    cells = load(spark, sf, "points").select(geo.cell_of("lat", "lon", 7).alias("cell")).distinct()
    return cells.select("cell", F.round(geo.centroid_lat("cell"), 6).alias("lat"),
                        F.round(geo.centroid_lon("cell"), 6).alias("lon"), geo.parent_exact("cell", 6, 7).alias("cell_r6"),
                        geo.parent_exact("cell", 5, 7).alias("cell_r5"), geo.parent_exact("cell", 4, 7).alias("cell_r4"))


def _corner(step: int, axis: str, cell: str, res: int) -> str:
    angle = math.radians(60.0 * step - 30.0)
    side = geo.SIDES[res]
    if axis == "lon":
        x = f"({d(side)} * {d(geo.SQRT3)} * (({cell_q(cell)}) + {cell_r(cell)} / 2.0) + {d(side * math.cos(angle))})"
        return f"degrees({x} / {d(geo.EARTH_RADIUS_KM * geo.C0)})"
    y = f"({d(side)} * 1.5 * {cell_r(cell)} + {d(side * math.sin(angle))})"
    return f"degrees(asin({y} * {d(geo.C0 / geo.EARTH_RADIUS_KM)}))"


_WKT = " || ', ' || ".join(
    f"printf('%.5f', {_corner(s % 6, 'lon', 'cell', 5)}) || ' ' || printf('%.5f', {_corner(s % 6, 'lat', 'cell', 5)})"
    for s in range(7))


@register("cell_outlines", query(f"""SELECT cell, 'POLYGON((' || {_WKT} || '))' AS wkt FROM
 (SELECT DISTINCT {cell_of('lat', 'lon', 5)} AS cell FROM points)""", "points"))
def cell_outlines(spark, sf):
    cells = load(spark, sf, "points").select(geo.cell_of("lat", "lon", 5).alias("cell")).distinct()
    return cells.select("cell", G.wkt("cell", 5).alias("wkt"))


@register("distances", query(f"""SELECT location_id, {fixed6(haversine('lat', 'lon', 'clat', 'clon'))} AS km,
 {fixed6(f"(lon - clon) * {d(geo.KM_PER_DEGREE_LON)} * cos(radians(lat))")} AS east_km, {fixed6(f"(lat - clat) * {d(geo.KM_PER_DEGREE_LAT)}")}
 AS north_km, {band(haversine('lat', 'lon', 'clat', 'clon'))} AS band, CASE WHEN km4 < 5 THEN '< 5' WHEN km4 < 10 THEN '5–10'
 WHEN km4 < 25 THEN '10–25' WHEN km4 < 50 THEN '25–50' WHEN km4 < 100 THEN '50–100' WHEN km4 < 200 THEN '100–200' ELSE '200+' END
 AS gap FROM (SELECT *, {haversine('lat', 'lon', 'clat', 'clon')} AS km4 FROM (SELECT *, {lat_of(cell_of('lat', 'lon', 3), 3)} AS clat,
 {lon_of(cell_of('lat', 'lon', 3), 3)} AS clon FROM points) a) b""", "points"))
def distances(spark, sf):
    rows = load(spark, sf, "points").withColumn("c", geo.cell_of("lat", "lon", 3))
    rows = rows.withColumn("clat", geo.centroid_lat("c", 3)).withColumn("clon", geo.centroid_lon("c", 3))
    km = geo.haversine_km("lat", "lon", "clat", "clon")
    east, north = geo.planar_offset_km("lat", "lon", "clat", "clon")
    return rows.select("location_id", geo.fixed6(km).alias("km"), geo.fixed6(east).alias("east_km"),
                       geo.fixed6(north).alias("north_km"), distance_band(km).alias("band"), gap_bin(km).alias("gap"))


@register("region_edges", query("""SELECT ord, name, ring, edge, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2,
 round(y2, 6) AS y2 FROM state_edges UNION ALL SELECT ord + 1000, name, ring, edge, round(x1, 6), round(y1, 6), round(x2, 6),
 round(y2, 6) FROM district_edges""", "state_edges", "district_edges"))
def region_edges(spark, sf):
    """Edges read back from GeoJSON text, polygons and multipolygons."""
    from skyhive.sources.files import rings_of

    def as_text(polygons, kind, shift):
        ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
        body = F.array(ring) if kind == "MultiPolygon" else ring
        return polygons.select((F.col("ord") + shift).cast("bigint").alias("ord"), F.col("name").alias("shape"),
                               F.lit(kind).alias("kind"), F.to_json(body).alias("coords"))

    text = as_text(states(spark, sf), "MultiPolygon", 0).unionByName(as_text(districts(spark, sf), "Polygon", 1000))
    sides = R.edges(rings_of(text))
    return sides.select("ord", "name", "ring", "edge", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@register("region_boxes", query("""SELECT ord, name, min(least(x1, x2)) AS west, min(least(y1, y2)) AS south,
 max(greatest(x1, x2)) AS east, max(greatest(y1, y2)) AS north FROM district_edges GROUP BY ord, name""", "district_edges"))
def region_boxes(spark, sf):
    return R.bounds(districts(spark, sf))


def assigned_sql(points: str, key: str, edges: str, label: str, snap: bool = True) -> str:
    inside = """sum(CASE WHEN (y1 > lat) <> (y2 > lat) THEN CASE WHEN lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
 THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1"""
    t = """least(1.0, greatest(0.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) /
 CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) = 0 THEN 1.0 ELSE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) END))"""
    gap = f"""sqrt((lon - x1 - {t} * (x2 - x1)) * (lon - x1 - {t} * (x2 - x1))
 + (lat - y1 - {t} * (y2 - y1)) * (lat - y1 - {t} * (y2 - y1)))"""
    reach = 0.05 if snap else 0.0
    return f"""SELECT {key}, coalesce(arg_min(name, ord) FILTER (inside), arg_min(name, (gap, ord))
 FILTER (NOT inside AND gap <= {d(reach)} AND {str(snap).upper()})) AS {label}
 FROM (SELECT {key}, ord, name, {inside} AS inside, min({gap}) AS gap FROM {points} p JOIN {edges} e
 ON p.lon BETWEEN (SELECT min(least(x1, x2)) FROM {edges} b WHERE b.ord = e.ord) - {d(reach)}
 AND (SELECT max(greatest(x1, x2)) FROM {edges} b WHERE b.ord = e.ord) + {d(reach)}
 AND p.lat BETWEEN (SELECT min(least(y1, y2)) FROM {edges} b WHERE b.ord = e.ord) - {d(reach)}
 AND (SELECT max(greatest(y1, y2)) FROM {edges} b WHERE b.ord = e.ord) + {d(reach)}
 GROUP BY {key}, ord, name) q GROUP BY {key}"""


fragment("point_states", assigned_sql("points", "location_id", "state_edges", "state"), "points", "state_edges")
fragment("point_districts", assigned_sql("points", "location_id", "district_edges", "city"), "points", "district_edges")


@register("geolocated_places", query("""SELECT location_id, state, city FROM point_states LEFT JOIN point_districts
 USING (location_id) WHERE state IS NOT NULL""", "point_states", "point_districts"))
def geolocated_places(spark, sf):
    return R.geolocate(load(spark, sf, "points"), states(spark, sf), districts(spark, sf), "location_id").select(
        "location_id", "state", "city")


# ---------------------------------------------------------------- grid

_SIDE = geo.SIDES[RES]
_X = lambda lon: geo.EARTH_RADIUS_KM * geo.C0 * math.radians(lon)
_Y = lambda lat: geo.EARTH_RADIUS_KM / geo.C0 * math.sin(math.radians(lat))
_R0, _R1 = math.floor(_Y(9) / (1.5 * _SIDE)) - 1, math.ceil(_Y(31) / (1.5 * _SIDE)) + 1
_Q0 = math.floor(_X(69) / (_SIDE * geo.SQRT3) - _R1 / 2) - 1
_Q1 = math.ceil(_X(91) / (_SIDE * geo.SQRT3) - _R0 / 2) + 1
fragment("lattice", f"""SELECT cell, {lat_of('cell', RES)} AS lat, {lon_of('cell', RES)} AS lon FROM (SELECT
 (CAST({RES} AS BIGINT) * {1 << 56} + (q + {geo.AXIS_OFFSET}) * {1 << 28} + (r + {geo.AXIS_OFFSET})) AS cell
 FROM range({_Q0}, {_Q1 + 1}) a(q), range({_R0}, {_R1 + 1}) b(r)) c WHERE lat BETWEEN 9 AND 31 AND lon BETWEEN 69 AND 91""")
fragment("state_cells", f"SELECT * FROM ({assigned_sql('lattice', 'cell', 'state_edges', 'state', False)}) z WHERE state IS NOT NULL",
         "lattice", "state_edges")
fragment("district_cells", f"SELECT * FROM ({assigned_sql('lattice', 'cell', 'district_edges', 'district', False)}) z"
         " WHERE district IS NOT NULL", "lattice", "district_edges")
fragment("votes", """SELECT district, state, count(*) AS votes, min(cell) AS first_cell FROM district_cells JOIN state_cells
 USING (cell) GROUP BY district, state""", "district_cells", "state_cells")
fragment("majority", "SELECT district, arg_max(state, (votes, -first_cell)) AS state FROM votes GROUP BY district", "votes")
fragment("grid", f"""SELECT cell, {lat_of('cell', RES)} AS lat, {lon_of('cell', RES)} AS lon, district,
 coalesce(s.state, m.state) AS state, {parent('cell', RES, 4)} AS cell_r4 FROM state_cells s
 FULL JOIN district_cells c USING (cell) LEFT JOIN majority m USING (district) WHERE coalesce(s.state, m.state) IS NOT NULL""",
         "state_cells", "district_cells", "majority")
fragment("sites", f"""SELECT station_id, min(station_name) AS station_name, min(lat) AS lat, min(lon) AS lon, min(city) AS city,
 min(state) AS state, min(health) AS health, count(*) AS rows, max(timestamp_utc) AS last_seen FROM readings GROUP BY station_id""", "readings")


def grid(spark, sf):
    return cut_lineage(G.build(states(spark, sf), districts(spark, sf), RES), "grid")


@register("district_states", query("SELECT district, state FROM majority", "majority"))
def district_states(spark, sf):
    return G.district_states(G.fill(states(spark, sf), RES, "state"), G.fill(districts(spark, sf), RES, "district"))


@register("grid_cells", query("""SELECT cell, round(lat, 6) AS lat, round(lon, 6) AS lon, district, state, cell_r4
 FROM grid""", "grid"))
def grid_cells(spark, sf):
    return grid(spark, sf).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


def closest_sql(where: str) -> str:
    return f"""SELECT cell, min(km) AS km, arg_min(station_id, (km, station_id)) AS station_id FROM (SELECT g.cell, s.station_id,
 {fixed6(haversine('g.lat', 'g.lon', 's.lat', 's.lon'))} AS km FROM grid g, sites s WHERE {where}) z GROUP BY cell"""


fragment("close_any", closest_sql("TRUE"), "grid", "sites")
fragment("close_ok", closest_sql("s.health = 'healthy'"), "grid", "sites")
fragment("full_grid", f"""SELECT g.*, CAST(coalesce(n, 0) AS INTEGER) AS station_count, a.km AS dist_km, a.station_id AS nearest_station_id,
 w.km AS dist_working_km, w.station_id AS nearest_working_station_id FROM grid g JOIN close_any a USING (cell) JOIN close_ok w USING (cell)
 LEFT JOIN (SELECT {cell_of('lat', 'lon', RES)} AS cell, count(*) AS n FROM sites GROUP BY 1) c USING (cell)""",
         "grid", "close_any", "close_ok", "sites")


def full_grid(spark, sf):
    return cut_lineage(G.with_stations(grid(spark, sf), sites(spark, sf), RES), "grid-stations")


@register("grid_nearest_station", query("""SELECT cell, station_count, dist_km, nearest_station_id, dist_working_km,
 nearest_working_station_id FROM full_grid""", "full_grid"))
def grid_nearest_station(spark, sf):
    return full_grid(spark, sf).select("cell", "station_count", "dist_km", "nearest_station_id", "dist_working_km",
                                       "nearest_working_station_id")


@register("gap_quantiles", query("""SELECT round(quantile_cont(dist_working_km, 0.5), 6) AS p50,
 round(quantile_cont(dist_working_km, 0.75), 6) AS p75, round(quantile_cont(dist_working_km, 0.9), 6) AS p90,
 round(quantile_cont(dist_working_km, 0.99), 6) AS p99, """ + ", ".join(
    f"round(100 * avg(CASE WHEN dist_working_km > {km} THEN 1.0::DOUBLE ELSE 0 END), 6) AS over_{km}_pct" for km in G.GAP_KM)
    + " FROM full_grid", "full_grid"))
def gap_quantiles(spark, sf):
    return G.gap_quantiles(full_grid(spark, sf), "dist_working_km")


@register("gaps_by_state", query("""SELECT state, count(*) AS cells, round(quantile_cont(dist_km, 0.5), 6) AS median_km,
 round(quantile_cont(dist_working_km, 0.5), 6) AS median_working_km,
 round(100 * avg(CASE WHEN dist_km > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_over_50km,
 coalesce(max(n), 0) AS stations, coalesce(max(ok), 0) AS healthy FROM full_grid LEFT JOIN (SELECT state, count(*) AS n,
 count(*) FILTER (health = 'healthy') AS ok FROM sites GROUP BY state) s USING (state) GROUP BY state""", "full_grid", "sites"))
def gaps_by_state(spark, sf):
    out = G.gaps_by_state(full_grid(spark, sf), sites(spark, sf))
    for c in ("median_km", "median_working_km", "pct_over_50km"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@register("grid_overview", query(f"""SELECT count(*) AS cells, round(count(*) * {d(geo.cell_area_km2(RES))}, 3) AS area_km2,
 count(*) FILTER (district IS NULL) AS no_district, count(*) FILTER (station_count > 0) AS cells_with_station,
 round(100 * avg(CASE WHEN station_count > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS station_cells_pct FROM full_grid""", "full_grid"))
def grid_overview(spark, sf):
    return G.grid_overview(full_grid(spark, sf), RES)


@register("stations_outside_grid", query(f"""SELECT station_id FROM sites WHERE {cell_of('lat', 'lon', RES)} NOT IN
 (SELECT cell FROM grid)""", "sites", "grid"))
def stations_outside_grid(spark, sf):
    return G.outside_grid(sites(spark, sf), grid(spark, sf), RES).select("station_id")


_STATE_MODE = """(SELECT cell_r4, arg_min(state, (-n, state)) AS state FROM (SELECT cell_r4, state, count(*) AS n FROM full_grid
 GROUP BY cell_r4, state) v GROUP BY cell_r4)"""
fragment("rolled", f"""SELECT cell_r4 AS cell, avg(dist_working_km) AS dist_working_km, avg(dist_km) AS dist_km, min(dist_km) AS dist_km_min,
 CAST(sum(station_count) AS BIGINT) AS station_count, any_value(m.state) AS state FROM full_grid LEFT JOIN {_STATE_MODE} m USING (cell_r4)
 GROUP BY cell_r4""", "full_grid")


@register("grid_rollup", query("""SELECT cell, round(dist_working_km, 10) AS dist_working_km, round(dist_km, 10) AS dist_km, dist_km_min,
 station_count, state FROM rolled""", "rolled"))
def grid_rollup(spark, sf):
    return (rollup.rollup_grid(full_grid(spark, sf), "cell_r4").withColumn("dist_km", F.round("dist_km", 10))
            .withColumn("dist_working_km", F.round("dist_working_km", 10)))


@register("rollup_payload", query("""SELECT 4 AS res, count(*) AS count, string_agg(lower(to_hex(cell)), ',' ORDER BY cell) AS cells,
 string_agg(printf('%.1f', dist_km), ',' ORDER BY cell) AS dist_km FROM rolled""", "rolled"))
def rollup_payload(spark, sf):
    """The columnar payload, read back from its JSON text."""
    rolled = rollup.rollup_grid(full_grid(spark, sf), "cell_r4").withColumn("res", F.lit(4))
    text = rollup.columnar(rolled, ["res"], {"dist_working_km": 1, "dist_km": 1, "station_count": None})
    back = F.from_json("payload", "res int, count bigint, cell array<string>, dist_km array<double>")
    return text.withColumn("p", back).select(
        "p.res", "p.count", F.array_join("p.cell", ",").alias("cells"),
        F.array_join(F.transform("p.dist_km", lambda v: F.format_string("%.1f", v)), ",").alias("dist_km"))


@register("display_features", query("SELECT cell, state, station_count, 7 AS corners, printf('%.1f', dist_km) AS dist_km FROM rolled", "rolled"))
def display_features(spark, sf):
    """GeoJSON features of the coarse map, read back from their text."""
    rolled = rollup.rollup_grid(full_grid(spark, sf), "cell_r4")
    about = F.struct(F.lower(F.hex("cell")).alias("cell"), F.round("dist_km", 1).alias("dist_km"),
                     F.round("dist_km_min", 1).alias("dist_km_min"), "station_count", "state")
    text = rolled.select("cell", G.geojson_feature("cell", about, 4).alias("f"))
    back = F.from_json("f", "type string, geometry struct<coordinates:array<array<array<double>>>>,"
                            " properties struct<dist_km:double,station_count:bigint,state:string>")
    return text.withColumn("b", back).select(
        "cell", "b.properties.state", "b.properties.station_count", F.size(F.col("b.geometry.coordinates")[0]).alias("corners"),
        F.format_string("%.1f", F.col("b.properties.dist_km")).alias("dist_km"))


_IN_BOX = f"lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}"


@register("box_query", query(f"""SELECT 4 AS res, cell_r4 AS cell, round(avg(dist_working_km), 10) AS dist_working_km, round(avg(dist_km), 10) AS dist_km,
 CAST(sum(station_count) AS BIGINT) AS station_count, count(*) OVER () > 7000 AS too_many FROM full_grid WHERE {_IN_BOX} GROUP BY cell_r4""", "full_grid"))
def box_query(spark, sf):
    """More cells than the limit of 1,000, so the query drops to a coarser level by itself."""
    out = rollup.box_query(full_grid(spark, sf), BOX, RES, max_cells=1000)
    return out.withColumn("dist_km", F.round("dist_km", 10)).withColumn("dist_working_km", F.round("dist_working_km", 10))


@register("stations_in_box", query(f"""SELECT station_id, station_name, printf('%.5f', lat) AS lat, city, rows,
 strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, health FROM sites WHERE {_IN_BOX}""", "sites"))
def stations_in_box(spark, sf):
    """Station list as JSON text, read back."""
    text = rollup.station_list(rollup.stations_in_box(sites(spark, sf), BOX))
    back = F.from_json("body", "station_name string, lat double, city string, rows bigint, last_seen string, health string")
    return text.withColumn("b", back).select("station_id", "b.station_name", F.format_string("%.5f", F.col("b.lat")).alias("lat"),
                                             "b.city", "b.rows", "b.last_seen", "b.health")


fragment("place_sites", f"""SELECT location_id, station_id, health, {fixed6(haversine('p.lat', 'p.lon', 's.lat', 's.lon'))} AS km
 FROM points p, sites s""", "points", "sites")


@register("nearest_k_stations", query("""SELECT location_id, station_id, km FROM place_sites
 QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY km, station_id) <= 3""", "place_sites"))
def nearest_k_stations(spark, sf):
    spots = load(spark, sf, "points").select(F.col("location_id").alias("target"), "lat", "lon")
    near = nearest_sites(spots, sites(spark, sf).select(F.col("station_id").alias("site"), "lat", "lon"), 3)
    return near.select(F.col("target").alias("location_id"), F.col("site").alias("station_id"), "km")


@register("stations_within_50km", query("""SELECT location_id, string_agg(health || '=' || n, ',' ORDER BY health) AS by_health
 FROM (SELECT location_id, health, count(*) AS n FROM place_sites WHERE km <= 50 GROUP BY location_id, health) z GROUP BY location_id""", "place_sites"))
def stations_within_50km(spark, sf):
    spots = load(spark, sf, "points").select(F.col("location_id").alias("target"), "lat", "lon")
    found = near_by_health(spots, sites(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("by_health")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select(F.col("target").alias("location_id"), F.array_join(pairs, ",").alias("by_health"))


@register("named_states", query("""SELECT location_id, state, 'place' || location_id AS match FROM point_states
 WHERE state IN ('State 3', 'State 12')""", "point_states"))
def named_states(spark, sf):
    placed = R.assign(load(spark, sf, "points"), states(spark, sf), "location_id", label="state")
    return R.only_states(placed, ["STATE  3", "Stàte-12"]).select(
        "location_id", "state", C.match_key("station_name").alias("match"))


@register("relevant_locations", query("""SELECT c_custkey AS location_id FROM customer WHERE c_custkey % 11 <> 0
 AND (c_custkey % 4 IN (2, 3) OR c_custkey % 5 = 0)"""))
def relevant_locations(spark, sf):
    """Locations with a position that were active in one of the wanted years."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS location_id", "CASE WHEN c_custkey % 11 <> 0 THEN 20D END AS lat",
        "array(CAST(2020 + c_custkey % 4 AS INT), CAST(CASE WHEN c_custkey % 5 = 0 THEN 2023 ELSE 2019 END AS INT)) AS years")
    return R.relevant_locations(rows, [2022, 2023]).select("location_id")
