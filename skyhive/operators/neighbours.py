"""Nearest sites without comparing everything with everything, and estimates from reporting neighbours."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyhive.functions import geo
from skyhive.session import cut_lineage

# Fixed values of the estimate
NEIGHBOURS = 8
POWER = 2.0
MIN_KM = 0.5

# Square mesh levels: level n has 2**n columns around the globe, the finest about 300 m wide; squares nest exactly.
LEVEL_STEP = 2
LEVELS = range(5, 18, LEVEL_STEP)
LIST_FACTOR = 3
SLACK = 1e-8  # radians, 6 cm: more than distances are rounded by

DAYS = 31  # days of the longest month
FOUND = "array<struct<km: double, station_id: {0}, value: double>>"


def _mesh(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    width = F.lit(360.0 / 2 ** level)
    return F.floor((lat + 90.0) / width), F.pmod(F.floor((lon + 180.0) / width), F.lit(2 ** level))


def _at_levels(df: DataFrame, levels: list[int], row: str, col: str) -> DataFrame:
    """Each point once for every level, with the square it lies in."""
    finest = LEVELS[-1]
    my, mx = _mesh(F.col("lat"), F.col("lon"), finest)
    spread = df.withColumn(row, my).withColumn(col, mx).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return spread.withColumns({c: F.expr(f"shiftright({c}, {finest} - level)") for c in (row, col)})


def _balls(squares: DataFrame, row: str, col: str, mark: str) -> DataFrame:
    """Adds the middle of each square on the unit sphere (mark_x, _y, _z), and radians within which all of it lies (mark_r)."""
    width = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    lat, lon = (F.col(row) + 0.5) * width - 90.0, (F.col(col) + 0.5) * width - 180.0
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(lat) - width / 2)))
    middle = zip("xyz", geo.unit_xyz(lat, lon))
    return squares.withColumns({**{f"{mark}_{n}": c for n, c in middle}, f"{mark}_r": F.radians(width / 2) * F.sqrt(1 + widest * widest)})


def _pruned(pairs: DataFrame, by: list[str], need: int, enough: int) -> DataFrame:
    """Squares of sites that can hold one of the `need` nearest sites of some point in a square of targets. `open`: more
    than `enough` sites are left, so that finer squares pay.

    So many sites as lie in the squares whose far side is nearest bound the distance; a square whose near side is beyond is out.
    """
    apart = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(geo.chord2("t_x", "t_y", "t_z", "s_x", "s_y", "s_z")) / 2))
    sized = pairs.select(*by, "level", "ty", "tx", "sy", "sx", "n", apart.alias("apart"), (F.col("t_r") + F.col("s_r")).alias("around"))
    sized = sized.withColumns({"near": F.col("apart") - F.col("around"), "far": F.col("apart") + F.col("around")})
    target = Window.partitionBy(*by, "ty", "tx")
    seen = F.sum("n").over(target.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bound = F.min(F.when(F.col("seen") >= need, F.col("far"))).over(target)
    kept = sized.withColumn("seen", seen).withColumn("bound", bound).where(
        F.col("bound").isNull() | (F.col("near") <= F.col("bound") + SLACK))
    more = (F.sum("n").over(target) > enough) & (F.col("level") < LEVELS[-1])
    return kept.select(*by, "level", "ty", "tx", "sy", "sx", more.alias("open"))


def _searched(targets: DataFrame, sites: DataFrame, by: list[str], need: int) -> tuple[DataFrame, list[int]]:
    """For each square of targets the squares of sites to search, as pairs at one level: by, level, ty, tx, sy, sx; and the levels."""
    levels = list(LEVELS)
    tops = cut_lineage(_balls(_at_levels(targets, levels, "ty", "tx").select(*by, "level", "ty", "tx").distinct(), "ty", "tx", "t"), "target-squares")
    held = cut_lineage(_balls(_at_levels(sites, levels, "sy", "sx").groupBy(*by, "level", "sy", "sx").agg(F.count(F.lit(1)).alias("n")),
                              "sy", "sx", "s"), "site-squares")
    enough, done, pairs = 4 * need + 16, [], None
    for level in levels:
        own, theirs = tops.where(F.col("level") == level), held.where(F.col("level") == level).drop("level")
        if pairs is None:
            met = own.join(theirs, by) if by else own.crossJoin(theirs)
        else:
            within = lambda df, cols: df.withColumns({f"in_{c}": F.shiftright(c, LEVEL_STEP) for c in cols})
            inside = pairs.where("open").select(*by, *[F.col(c).alias(f"in_{c}") for c in ("ty", "tx", "sy", "sx")])
            met = (inside.join(within(theirs, ["sy", "sx"]).hint("shuffle_hash"), [*by, "in_sy", "in_sx"])
                   .join(within(own, ["ty", "tx"]).hint("shuffle_hash"), [*by, "in_ty", "in_tx"]))
        pairs = cut_lineage(_pruned(met, by, need, enough), "squares")
        done.append(pairs.where("NOT open").drop("open"))
        if pairs.where("open").isEmpty():
            break
    return reduce(DataFrame.unionByName, done), levels[:len(done)]


def nearest_sites(targets: DataFrame, sites: DataFrame, m: int, by: list[str] | None = None,
                  skip_same: bool = False) -> DataFrame:
    """The m nearest sites of each target: target, site, km, plus the `by` columns both sides share.

    targets: target, lat, lon. sites: site, lat, lon. With skip_same a site never serves the target of the
    same id. Ties at the same distance (to a millimetre) go to the smaller site id.

    Squares of targets meet squares of sites, level by level. A pair of squares is dropped once enough sites are
    surely nearer, and squares are halved only while more than a few times m sites are left. So a target is compared
    with a few times m sites, however many lie in reach, and crowded places beside empty ones cost little.
    """
    by = list(by or [])
    need = m + 1 if skip_same else m
    placed = lambda df, key: df.select(*by, key, "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    sites, targets = cut_lineage(placed(sites, "site"), "sites"), cut_lineage(placed(targets, "target"), "targets")
    searched, levels = _searched(targets, sites, by, need)
    keys = [*by, "target"]
    tx, ty, tz = (c.alias(n) for c, n in zip(geo.unit_xyz("lat", "lon"), ("t_x", "t_y", "t_z")))
    sx, sy, sz = (c.alias(n) for c, n in zip(geo.unit_xyz("lat", "lon"), ("s_x", "s_y", "s_z")))
    meshed = _at_levels(sites, levels, "sy", "sx").select(*by, "level", "sy", "sx", "site", sx, sy, sz)
    ready = _at_levels(targets, levels, "ty", "tx").select(*keys, "level", "ty", "tx", tx, ty, tz)
    # Trigonometry is done before the joins; a pair costs three differences and one arc sine.
    in_reach = searched.join(meshed.hint("shuffle_hash"), [*by, "level", "sy", "sx"])
    pairs = ready.hint("shuffle_hash").join(in_reach, [*by, "level", "ty", "tx"]).withColumn(
        "km", geo.chord_km(geo.chord2("t_x", "t_y", "t_z", "s_x", "s_y", "s_z")))
    if skip_same:
        pairs = pairs.where(F.col("site") != F.col("target"))
    pairs = pairs.select(*keys, "site", geo.fixed6("km").alias("km"))
    if m == 1:  # one winner: a combining aggregate, nothing to rank
        return pairs.groupBy(*keys).agg(F.min(F.struct("km", "site")).alias("w")).select(
            *keys, F.col("w.site").alias("site"), F.col("w.km").alias("km"))
    order = Window.partitionBy(*keys).orderBy("km", "site")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= m).drop("_n")


def station_cells(stations: DataFrame, res: int) -> DataFrame:
    """Stations with their cell and its centroid; all distances run from centroid to centroid."""
    placed = stations.withColumn("cell", geo.cell_of("lat", "lon", res))
    return (placed.withColumn("cell_lat", geo.centroid_lat("cell", res))
            .withColumn("cell_lon", geo.centroid_lon("cell", res)))


def _cell_values(values: DataFrame, k: int) -> DataFrame:
    """Per cell and period the first k values by station id: stations of a cell are equally far from anywhere."""
    order = Window.partitionBy("cell", "period").orderBy("station_id")
    ranked = values.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return ranked.groupBy("cell", "period").agg(
        F.array_sort(F.collect_list(F.struct("station_id", "value"))).alias("seen"))


def _histories(seen: DataFrame, month: Column) -> DataFrame:
    """Per site and month one vector: what its stations said on each day, NULL on days without a value."""
    entry = F.struct(F.dayofmonth("period").alias("day"), "seen")
    by_day = F.map_from_entries(F.collect_list(entry))  # one entry a day
    grouped = seen.groupBy(F.col("cell").alias("site"), month).agg(by_day.alias("by_day"))
    return grouped.select("site", "month", F.transform(
        F.sequence(F.lit(1), F.lit(DAYS)), lambda d: F.try_element_at("by_day", d)).alias("days"))


def _estimates(found: Column, k: int, power: float) -> dict[str, Column]:
    """Estimate columns from an ordered array of struct(km, station_id, value) of the k used neighbours."""
    weight = lambda e: 1.0 / F.pow(F.greatest(e["km"], F.lit(MIN_KM)), F.lit(power))
    total = lambda f: F.aggregate(F.transform(found, f), F.lit(0.0), lambda a, b: a + b)
    mean = total(lambda e: e["value"]) / F.size(found)
    spread = F.sqrt(F.aggregate(found, F.lit(0.0), lambda a, e: a + (e["value"] - mean) * (e["value"] - mean))
                    / F.size(found))
    any_value = F.size(found) > 0
    return {
        "neighbour_idw": F.when(any_value, total(lambda e: e["value"] * weight(e)) / total(weight)),
        "neighbour_nearest": F.try_element_at(found, F.lit(1))["value"],
        "dist_nearest_km": F.try_element_at(found, F.lit(1))["km"],
        "neighbour_spread": F.when(any_value, spread),
    }


def neighbour_features(queries: DataFrame, values: DataFrame, k: int = NEIGHBOURS, power: float = POWER,
                       hide_own_cell: bool = True) -> DataFrame:
    """Features of each (cell, period) from the k nearest stations that reported in that period.

    queries: cell, period (a date; NULL asks for nothing), cell_lat, cell_lon. values: station_id, cell,
    cell_lat, cell_lon, period, value. With hide_own_cell all stations of the query's own cell are left out, so
    a hidden station can never reach its own features.

    Distances are worked out once between cells, not once per period: each cell gets a list of its nearest
    cells, a few times longer than k. A reporting cell's values are one vector of days per month, and the
    periods asked of a cell one bit per day, so lists meet vectors once a month; days are looked up in place
    and no cell-day is exploded over its neighbours. The few queries whose list holds fewer than k reporting
    stations are searched again exactly, among the cells of their period.
    """
    month = F.trunc("period", "month").alias("month")
    asked = (queries.where(F.col("period").isNotNull()).groupBy("cell", month)
             .agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"),
                  F.bit_or(F.expr("shiftleft(1, dayofmonth(period) - 1)")).alias("days_asked")))
    seen = _cell_values(values, k)
    spots = values.select("cell", "cell_lat", "cell_lon").distinct()
    m = LIST_FACTOR * k
    lists = nearest_sites(
        asked.select(F.col("cell").alias("target"), F.col("cell_lat").alias("lat"),
                     F.col("cell_lon").alias("lon")).distinct(),
        spots.select(F.col("cell").alias("site"), F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")),
        m, skip_same=hide_own_cell)
    lists = lists.withColumn("listed", F.count(F.lit(1)).over(Window.partitionBy("target")))
    near = (lists.join(_histories(seen, month).join(asked.select("month").distinct(), "month", "left_semi"), "site")
            .groupBy(F.col("target").alias("cell"), "month")
            .agg(F.max("listed").alias("listed"), F.collect_list(F.struct("km", "days")).alias("near")))  # m at most
    on_day = lambda d: F.transform(
        F.filter("near", lambda n: F.get(n["days"], d - 1).isNotNull()),
        lambda n: F.transform(F.get(n["days"], d - 1), lambda s: F.struct(
            n["km"].alias("km"), s["station_id"].alias("station_id"), s["value"].alias("value"))))
    wanted = F.filter(F.sequence(F.lit(1), F.lit(DAYS)), lambda d: F.getbit("days_asked", d - 1) == 1)
    by_day = F.transform(wanted, lambda d: F.struct(
        d.alias("day"), F.coalesce(F.slice(F.array_sort(F.flatten(on_day(d))), 1, k),
                                   F.array().cast(FOUND.format(values.schema["station_id"].dataType.simpleString()))).alias("found")))
    first = cut_lineage(
        asked.join(near, ["cell", "month"], "left")
        .select("cell", "month", "cell_lat", "cell_lon", F.coalesce(F.col("listed") < m, F.lit(False)).alias("complete"),
                F.explode(by_day).alias("d"))
        .select("cell", F.date_add("month", F.col("d.day") - 1).alias("period"), "cell_lat", "cell_lon", "complete",
                "d.found"))
    done = (F.size("found") >= k) | F.col("complete")
    settled, missing = first.where(done).select("cell", "period", "found"), first.where(~done)
    if not missing.isEmpty():  # a search is many small jobs, also for no query at all
        settled = settled.unionByName(_second_search(missing, seen, spots, k, hide_own_cell))
    return _finish(settled, values, k, power, hide_own_cell)


def _second_search(missing: DataFrame, seen: DataFrame, spots: DataFrame, k: int, hide: bool) -> DataFrame:
    """Exact search among the cells that reported in the period, for the queries still short of k."""
    periods = missing.select("period").distinct()
    there = seen.join(periods, "period", "left_semi").join(spots, "cell")
    again = nearest_sites(
        missing.select("period", F.col("cell").alias("target"), F.col("cell_lat").alias("lat"),
                       F.col("cell_lon").alias("lon")),
        there.select("period", F.col("cell").alias("site"), F.col("cell_lat").alias("lat"),
                     F.col("cell_lon").alias("lon")), k, by=["period"], skip_same=hide)
    entry = F.transform("seen", lambda s: F.struct(
        F.col("km").alias("km"), s["station_id"].alias("station_id"), s["value"].alias("value")))
    got = (again.join(seen.withColumnRenamed("cell", "site"), ["site", "period"])
           .groupBy(F.col("target").alias("cell"), "period")
           .agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, k).alias("found")))
    return missing.select("cell", "period", F.col("found").alias("none_yet")).join(
        got, ["cell", "period"], "left").select("cell", "period", F.coalesce("found", "none_yet").alias("found"))


def _finish(found: DataFrame, values: DataFrame, k: int, power: float, hide: bool) -> DataFrame:
    estimates = _estimates(F.col("found"), k, power)
    out = found.select("cell", "period", *[c.alias(n) for n, c in estimates.items()])
    per_cell = values.groupBy("cell", "period").agg(F.count(F.lit(1)).alias("here"))
    in_all = per_cell.groupBy("period").agg(F.sum("here").alias("everywhere"))
    out = out.join(in_all, "period", "left")
    reporting = F.coalesce("everywhere", F.lit(0))
    if hide:
        out = out.join(per_cell, ["cell", "period"], "left")
        reporting = reporting - F.coalesce("here", F.lit(0))
    return out.select("cell", "period", *estimates, reporting.cast("int").alias("n_reporting"))


def near_by_health(targets: DataFrame, stations: DataFrame, km: float = 50.0) -> DataFrame:
    """Stations within a distance, counted by health, as one map per target. targets: target, lat, lon."""
    step = km / 110.0
    reach = F.lit(step) / F.cos(F.radians(F.least(F.abs(F.col("lat")) + step, F.lit(89.9))))
    mesh = lambda v: F.floor(v / F.lit(step))
    spread = (targets.select("target", "lat", "lon")
              .withColumn("my", F.explode(F.sequence(mesh(F.col("lat")) - 1, mesh(F.col("lat")) + 1)))
              .withColumn("mx", F.explode(F.sequence(mesh(F.col("lon") - reach), mesh(F.col("lon") + reach)))))
    sites = stations.select("station_id", "health", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
                            mesh(F.col("lat")).alias("my"), mesh(F.col("lon")).alias("mx"))
    counts = (spread.join(sites, ["my", "mx"])
              .where(geo.haversine_km("lat", "lon", "s_lat", "s_lon") <= km)
              .groupBy("target", "health").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("health", "n")))).alias("by_health"))
