"""Hidden-station validation, bootstrap intervals, the decision, and learned models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhive.functions import geo
from skyhive.operators import bootstrap as B
from skyhive.operators import deploy as DE
from skyhive.operators import learn as L
from skyhive.operators import predict as P
from skyhive.operators import rollup
from skyhive.operators import stations as ST
from skyhive.operators import validate as V
from skyhive.operators.features import FEATURE_GROUPS, FEATURES
from skyhive.registry.adapters import RES, STATION_RES, load, sites
from skyhive.registry.book import register
from skyhive.registry.history import MIN_HOURS
from skyhive.registry.signals import bare_days, cell_days, full_days
from skyhive.registry.sqltext import band, cell_of, fixed6, fragment, haversine, lat_of, lon_of, pm25_class, query
from skyhive.session import cut_lineage, shared_path, side_by_side
from skyhive.sinks.tables import replace_partitions

K = 8
DRAWS = 2000
MODELS = ["nearest_station", "idw_k8", "combined"]

fragment("site_cells", f"""SELECT *, {lat_of('cell', STATION_RES)} AS cell_lat, {lon_of('cell', STATION_RES)} AS cell_lon FROM
 (SELECT *, {cell_of('lat', 'lon', STATION_RES)} AS cell FROM sites) s""", "sites")
fragment("obs", """SELECT d.station_id, period, value, cell, cell_lat, cell_lon FROM daily d JOIN site_cells USING (station_id)""", "daily", "site_cells")
fragment("neighbours", f"""SELECT a.station_id, a.cell, a.period, a.value AS actual, b.station_id AS other, b.value,
 {fixed6(haversine('a.cell_lat', 'a.cell_lon', 'b.cell_lat', 'b.cell_lon'))} AS km, count(*) OVER w AS n_reporting,
 row_number() OVER (w ORDER BY {fixed6(haversine('a.cell_lat', 'a.cell_lon', 'b.cell_lat', 'b.cell_lon'))}, b.station_id) AS rank
 FROM obs a JOIN obs b ON a.period = b.period AND a.cell <> b.cell WINDOW w AS (PARTITION BY a.station_id, a.period)""", "obs")
fragment("hidden", f"""SELECT o.station_id, o.cell, o.period, o.value AS actual, neighbour_idw, neighbour_nearest, dist_nearest_km, neighbour_spread,
 CASE WHEN EXISTS (SELECT 1 FROM obs q WHERE q.period = o.period) THEN coalesce(n_reporting, 0) END AS n_reporting,
 {band('dist_nearest_km')} AS band FROM obs o LEFT JOIN (SELECT station_id, period,
 sum(value / power(greatest(km, 0.5), 2)) / sum(1 / power(greatest(km, 0.5), 2)) AS neighbour_idw,
 max(value) FILTER (rank = 1) AS neighbour_nearest, max(km) FILTER (rank = 1) AS dist_nearest_km, stddev_pop(value) AS neighbour_spread,
 max(n_reporting) AS n_reporting FROM neighbours WHERE rank <= {K} GROUP BY station_id, period) n USING (station_id, period)""", "obs", "neighbours")
fragment("two_models", """SELECT station_id, 'nearest_station' AS model, period, dist_nearest_km, band, actual, neighbour_nearest AS predicted FROM hidden
 UNION ALL SELECT station_id, 'idw_k8', period, dist_nearest_km, band, actual, neighbour_idw FROM hidden""", "hidden")
fragment("combined", """SELECT station_id, 'combined' AS model, period, dist_nearest_km, band, actual,
 CASE WHEN dist_nearest_km <= 100 THEN neighbour_idw ELSE neighbour_nearest END AS predicted,
 CASE WHEN dist_nearest_km <= 100 THEN 'idw_k8' ELSE 'nearest_station' END AS component FROM hidden""", "hidden")
fragment("all_models", "SELECT * FROM two_models UNION ALL SELECT * EXCLUDE (component) FROM combined", "two_models", "combined")


def observations(spark, sf):
    daily = ST.daily_means(ST.hourly_means(load(spark, sf, "readings")), MIN_HOURS)
    return V.observations(daily, sites(spark, sf), STATION_RES)


def hidden(spark, sf, values=None):
    values = cut_lineage(observations(spark, sf), "observations") if values is None else values
    return V.hidden_features(values, k=K)


@register("hidden_station_features", query("""SELECT station_id, period, actual, round(neighbour_idw, 6) AS neighbour_idw,
 round(neighbour_nearest, 6) AS neighbour_nearest, dist_nearest_km, round(neighbour_spread, 6) AS neighbour_spread,
 CAST(n_reporting AS INTEGER) AS n_reporting, band FROM (SELECT * REPLACE (round(actual, 6) AS actual) FROM hidden) h""", "hidden"))
def hidden_station_features(spark, sf):
    out = hidden(spark, sf)
    return out.select("station_id", "period", *[F.round(c, 6).alias(c) for c in (
        "actual", "neighbour_idw", "neighbour_nearest", "neighbour_spread")], "dist_nearest_km", "n_reporting", "band")


def two_models(spark, sf):
    return V.per_period(hidden(spark, sf))


def all_models(spark, sf):
    base = cut_lineage(two_models(spark, sf), "per-period")
    return base.unionByName(B.combine(base, "idw_k8", "nearest_station").drop("component"))


_ERR, _OK = "predicted - actual", "predicted IS NOT NULL"
fragment("bands", f"""SELECT model, band, count(DISTINCT station_id) AS stations, count(*) AS station_periods, avg(abs({_ERR})) AS mae,
 100 * avg(abs({_ERR})) / avg(actual) AS nmae_pct, avg({_ERR}) AS bias, avg(actual) AS actual_mean,
 100 * avg(CASE WHEN {pm25_class('actual')} = {pm25_class('predicted')} THEN 1.0::DOUBLE ELSE 0 END) AS category_agreement_pct
 FROM all_models WHERE {_OK} AND band <> 'no remaining data' GROUP BY model, band""", "all_models")
BAND_NUMBERS = ["mae", "nmae_pct", "bias", "actual_mean", "category_agreement_pct"]


@register("band_errors", query("SELECT b.model, b.band, stations, station_periods, " + ", ".join(f"round({c}, 9) AS {c}" for c in BAND_NUMBERS)
    + f""", round(m.v, 9) AS median_station_mae FROM bands b JOIN (SELECT model, band, quantile_cont(mae, 0.5) AS v FROM (SELECT model, band, station_id,
 avg(abs({_ERR})) AS mae FROM two_models WHERE {_OK} GROUP BY ALL) s GROUP BY model, band) m ON m.model = b.model AND m.band = b.band
 WHERE b.model <> 'combined'""", "bands", "two_models"))
def band_errors(spark, sf):
    out = V.band_table(two_models(spark, sf))
    return out.select("model", "band", "stations", "station_periods", *[
        F.round(c, 9).alias(c) for c in [*BAND_NUMBERS, "median_station_mae"]])


@register("improvement_by_band", query("""SELECT m.model, m.band, m.station_periods, round(b.mae, 9) AS baseline_mae, round(m.mae, 9) AS model_mae,
 round(b.mae - m.mae, 9) AS mae_improvement, round(100 * (b.mae - m.mae) / b.mae, 9) AS mae_improvement_pct,
 round(b.nmae_pct, 9) AS baseline_nmae_pct, round(m.nmae_pct, 9) AS model_nmae_pct FROM bands m JOIN bands b ON b.band = m.band
 AND b.model = 'idw_k8' WHERE m.model <> 'idw_k8'""", "bands"))
def improvement_by_band(spark, sf):
    out = V.improvement(cut_lineage(V.band_errors(all_models(spark, sf)), "bands"))  # no median is read
    keys = ["model", "band", "station_periods"]
    return out.select(*keys, *[F.round(c, 9).alias(c) for c in out.columns if c not in keys])


@register("station_scores", query(f"""SELECT s.station_id, model, periods, predicted, round(mae, 9) AS mae, round(bias, 9) AS bias, round(rmse, 9) AS rmse,
 round(r, 4) AS r, round(agreement, 9) AS category_agreement, round(median_km, 9) AS median_nearest_reporting_km, {band('median_km')} AS band,
 (SELECT count(*) - 1 FROM site_cells x WHERE x.cell = c.cell) AS hidden_in_same_hex,
 (SELECT min({fixed6(haversine('c.cell_lat', 'c.cell_lon', 'x.cell_lat', 'x.cell_lon'))}) FROM site_cells x WHERE x.cell <> c.cell) AS nearest_remaining_km
 FROM (SELECT station_id, model, count(*) AS periods, count(predicted) AS predicted, avg(abs({_ERR})) AS mae, avg({_ERR}) AS bias,
 sqrt(avg(({_ERR}) * ({_ERR}))) AS rmse, CASE WHEN count(predicted) > 2 AND min(actual) < max(actual) AND min(predicted) < max(predicted)
 THEN corr(actual, predicted) END AS r, avg(CASE WHEN {_OK} THEN CASE WHEN {pm25_class('actual')} = {pm25_class('predicted')} THEN 1.0::DOUBLE ELSE 0 END END)
 AS agreement, quantile_cont(dist_nearest_km, 0.5) AS median_km FROM two_models GROUP BY station_id, model) s JOIN site_cells c USING (station_id)""",
    "two_models", "site_cells"))
def station_scores(spark, sf):
    cover = ST.coverage(ST.hourly_means(load(spark, sf, "readings")))
    out = V.per_station(two_models(spark, sf), sites(spark, sf), cover, STATION_RES)
    rounded = {c: 9 for c in ("mae", "bias", "rmse", "category_agreement", "median_nearest_reporting_km")} | {"r": 4}
    return out.select("station_id", "model", "periods", "predicted", *[F.round(c, n).alias(c) for c, n in rounded.items()],
                      "band", "hidden_in_same_hex", "nearest_remaining_km")


@register("combined_predictions", query("""SELECT station_id, period, band, round(predicted, 6) AS predicted, component FROM combined""", "combined"))
def combined_predictions(spark, sf):
    out = B.combine(two_models(spark, sf), "idw_k8", "nearest_station")
    return out.select("station_id", "period", "band", F.round("predicted", 6).alias("predicted"), "component")


fragment("paired", """SELECT station_id, period, band, max(actual) AS actual, max(predicted) FILTER (model = 'nearest_station') AS nearest_station,
 max(predicted) FILTER (model = 'idw_k8') AS idw_k8, max(predicted) FILTER (model = 'combined') AS combined FROM all_models
 WHERE band <> 'no remaining data' GROUP BY station_id, period, band HAVING count(predicted) = 3""", "all_models")


def paired(spark, sf):
    return cut_lineage(B.paired(all_models(spark, sf), MODELS), "paired")


@register("paired_predictions", query("SELECT station_id, period, band, round(actual, 6) AS actual, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in MODELS) + " FROM paired", "paired"))
def paired_predictions(spark, sf):
    return B.paired(all_models(spark, sf), MODELS).select(
        "station_id", "period", "band", F.round("actual", 6).alias("actual"), *[F.round(m, 6).alias(m) for m in MODELS])


fragment("ranked_stations", """SELECT station_id, row_number() OVER (ORDER BY md5('|' || station_id)) - 1 AS pos, count(*) OVER () AS n
 FROM (SELECT DISTINCT station_id FROM paired) s""", "paired")
fragment("draws", f"""SELECT draw, pos, count(*) AS times FROM (SELECT draw, CAST('0x' || substr(md5('0|' || draw || '|' || pos), 1, 7) AS BIGINT) % n AS pos
 FROM ranked_stations, range({DRAWS}) t(draw)) z GROUP BY draw, pos""", "ranked_stations")
fragment("sums", "SELECT station_id, band, count(*) AS n, sum(actual) AS actual, " + ", ".join(
    f"sum(abs({m} - actual)) AS {m}" for m in MODELS) + " FROM paired GROUP BY station_id, band", "paired")
fragment("drawn", "SELECT draw, band, sum(times * sums.n) AS n, " + ", ".join(f"sum(times * sums.{m}) AS {m}" for m in MODELS)
         + " FROM draws JOIN ranked_stations r USING (pos) JOIN sums USING (station_id) GROUP BY draw, band", "draws", "ranked_stations", "sums")


def _gain(base: str, m: str) -> str:
    return "CAST(NULL AS DOUBLE)" if base == m else f"100 * ({base} - {m}) / nullif({base}, 0)"


fragment("drawn_long", " UNION ALL ".join(f"""SELECT band, '{m}' AS model, {m} / n AS mae, {_gain('idw_k8', m)} AS vs_idw,
 {_gain('nearest_station', m)} AS vs_nearest FROM drawn""" for m in MODELS), "drawn")
fragment("points_long", " UNION ALL ".join(f"""SELECT band, '{m}' AS model, count(*) AS stations, CAST(sum(n) AS BIGINT) AS station_days,
 sum({m}) / sum(n) AS mae, 100 * sum({m}) / sum(actual) AS nmae_pct, {_gain('sum(idw_k8)', f'sum({m})')} AS vs_idw_pct,
 {_gain('sum(nearest_station)', f'sum({m})')} AS vs_nearest_pct FROM sums GROUP BY band""" for m in MODELS), "sums")
fragment("intervals", """SELECT p.*, mae_lo, mae_hi, vs_idw_lo, vs_idw_hi, vs_nearest_lo, vs_nearest_hi FROM points_long p JOIN (SELECT band, model,
 """ + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{s}" for c in ("mae", "vs_idw", "vs_nearest") for s, q in (("lo", 0.025), ("hi", 0.975)))
         + " FROM drawn_long GROUP BY band, model) b USING (band, model)", "points_long", "drawn_long")
INTERVALS = ["mae", "nmae_pct", "vs_idw_pct", "vs_nearest_pct", "mae_lo", "mae_hi", "vs_idw_lo", "vs_idw_hi", "vs_nearest_lo", "vs_nearest_hi"]


def intervals(spark, sf):
    return B.station_bootstrap(paired(spark, sf), MODELS, DRAWS)


@register("station_bootstrap", query("SELECT band, model, stations, station_days, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in INTERVALS) + """ FROM (SELECT * REPLACE (CASE WHEN model = 'idw_k8' THEN NULL ELSE vs_idw_pct END AS vs_idw_pct,
 CASE WHEN model = 'nearest_station' THEN NULL ELSE vs_nearest_pct END AS vs_nearest_pct) FROM intervals) i""", "intervals"))
def station_bootstrap(spark, sf):
    out = intervals(spark, sf)
    return out.select("band", "model", "stations", "station_days", *[F.round(c, 6).alias(c) for c in INTERVALS])


@register("paired_improvement", query("""SELECT p.band, p.stations, p.station_days, round(p.g, 6) AS improvement_pct, round(lo, 6) AS lo, round(hi, 6) AS hi,
 CASE WHEN lo > 0 THEN 'yes' WHEN hi < 0 THEN 'worse' ELSE 'not established' END AS clearly_better FROM (SELECT band, count(*) AS stations,
 CAST(sum(n) AS BIGINT) AS station_days, 100 * (sum(nearest_station) - sum(combined)) / sum(nearest_station) AS g FROM sums GROUP BY band) p JOIN (SELECT band,
 quantile_cont(100 * (nearest_station - combined) / nullif(nearest_station, 0), 0.025) AS lo,
 quantile_cont(100 * (nearest_station - combined) / nullif(nearest_station, 0), 0.975) AS hi FROM drawn GROUP BY band) q USING (band)""", "sums", "drawn"))
def paired_improvement(spark, sf):
    out = B.paired_improvement(paired(spark, sf), "combined", "nearest_station", DRAWS)
    return out.select("band", "stations", "station_days", *[F.round(c, 6).alias(c) for c in ("improvement_pct", "lo", "hi")], "clearly_better")


@register("decision", query("""SELECT coalesce(bool_and(coalesce(vs_idw_lo > 0, FALSE)), FALSE) AND count(*) = 2 AS wins,
 CASE WHEN coalesce(bool_and(coalesce(vs_idw_lo > 0, FALSE)), FALSE) AND count(*) = 2 THEN 'combined' ELSE 'idw_k8' END AS promoted
 FROM intervals WHERE model = 'combined' AND band IN ('20-50 km', '100 km+')""", "intervals"))
def decision(spark, sf):
    return B.decide(intervals(spark, sf), "combined", "idw_k8")


_LEVEL = "CASE band WHEN '0-20 km' THEN 0 WHEN '100 km+' THEN 2 ELSE 1 END"
fragment("levels", f"""SELECT CAST({_LEVEL} AS INTEGER) AS level, round_even(sum(nmae_pct * station_days) / sum(station_days), 1) AS rel_error_pct
 FROM points_long WHERE model = 'idw_k8' GROUP BY 1""", "points_long")


def levels(spark, sf, values=None):
    """Error of each confidence level, of one model: neither the other model nor a median over stations is worked out."""
    periods = V.per_period(hidden(spark, sf, values), {"neighbour_idw": "idw_k8"})
    table = cut_lineage(V.band_errors(periods).withColumn("station_days", F.col("station_periods")), "level-bands")
    return B.confidence_levels(table, "idw_k8")


@register("confidence_levels", query("""SELECT level, rel_error_pct, ['high', 'medium', 'low'][level + 1] AS label FROM levels""", "levels"))
def confidence_levels(spark, sf):
    return B.confidence_levels(intervals(spark, sf), "idw_k8")


BLOCK = ["mae", "bias", "r", "category", "vs_idw", "mae_lo", "mae_hi", "category_lo", "category_hi", "vs_idw_lo", "vs_idw_hi"]
BLOCK_DRAWS = 2000
fragment("series", """SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY period) - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n FROM paired""", "paired")
fragment("block_rows", f"""SELECT station_id, draw, CAST('0x' || substr(md5('0|' || draw || '|' || block), 1, 7) AS BIGINT) % (greatest(n - 7, 0) + 1) + step AS pos
 FROM (SELECT DISTINCT station_id, n FROM series) s, range({BLOCK_DRAWS}) a(draw), range(7) b(step), range((SELECT CAST(ceil(max(n) / 7.0) AS BIGINT) FROM series)) c(block) WHERE block < ceil(n / 7.0) AND block * 7 + step < n""", "series")


def _block_sql(group: str, source: str, m: str) -> str:
    return f"""SELECT {group}, '{m}' AS model, count(*) AS days, avg(abs({m} - actual)) AS mae, avg({m} - actual) AS bias,
 CASE WHEN count(*) > 1 AND stddev_pop(actual) > 1e-9 AND stddev_pop({m}) > 1e-9 THEN corr(actual, {m}) END AS r,
 avg(CASE WHEN {pm25_class('actual')} = {pm25_class(m)} THEN 1.0::DOUBLE ELSE 0 END) AS category,
 {'CAST(NULL AS DOUBLE)' if m == 'idw_k8' else f'100 * (avg(abs(idw_k8 - actual)) - avg(abs({m} - actual))) / nullif(avg(abs(idw_k8 - actual)), 0)'} AS vs_idw
 FROM {source} GROUP BY {group}"""


_SERIES_MODELS = ["idw_k8", "nearest_station"]
fragment("block_draws", " UNION ALL ".join(_block_sql("station_id, draw", "block_rows JOIN series USING (station_id, pos)", m) for m in _SERIES_MODELS), "block_rows", "series")


@register("block_bootstrap", query("SELECT p.station_id, p.model, p.days, " + ", ".join(f"round({c}, 11) AS {c}" for c in BLOCK if c != "r")
    + ", round(r, 4) AS r FROM (" + " UNION ALL ".join(_block_sql("station_id", "series", m) for m in _SERIES_MODELS)
    + ") p JOIN (SELECT station_id, model, " + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{s}" for c in ("mae", "category", "vs_idw")
    for s, q in (("lo", 0.025), ("hi", 0.975))) + " FROM block_draws GROUP BY station_id, model) b USING (station_id, model)", "block_draws", "series"))
def block_bootstrap(spark, sf):
    out = B.block_bootstrap(paired(spark, sf), _SERIES_MODELS, draws=BLOCK_DRAWS)
    steady = F.when(~F.isnan("r") & (F.col("days") > 1), F.round("r", 4))
    return out.select("station_id", "model", "days", *[F.round(c, 11).alias(c) for c in BLOCK if c != "r"], steady.alias("r"))


@register("nearest_remaining", query(f"""SELECT a.station_id AS target, row_number() OVER (PARTITION BY a.station_id ORDER BY km, b) AS rank, b AS station_id, km
 FROM (SELECT x.station_id, y.station_id AS b, {fixed6(haversine('x.cell_lat', 'x.cell_lon', 'y.cell_lat', 'y.cell_lon'))} AS km FROM site_cells x
 JOIN site_cells y ON x.cell <> y.cell WHERE x.station_id IN ('st-3', 'st-11', 'st-7')) a QUALIFY rank <= 5""", "site_cells"))
def nearest_remaining(spark, sf):
    cover = ST.coverage(ST.hourly_means(load(spark, sf, "readings")))
    return V.nearest_remaining(sites(spark, sf), cover, ["st-3", "st-11", "st-7"], STATION_RES).select(
        "target", F.col("rank").cast("bigint").alias("rank"), "station_id", "km")


@register("station_series", query("""SELECT CAST(day AS DATE) AS period, round(actual, 6) AS actual, round(neighbour_nearest, 6) AS nearest_station, round(neighbour_idw, 6) AS idw_k8
 FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS day FROM hidden WHERE station_id = 'st-5') c
 LEFT JOIN hidden h ON h.period = CAST(day AS DATE) AND h.station_id = 'st-5'""", "hidden"))
def station_series(spark, sf):
    out = V.series_of(two_models(spark, sf), "st-5", ["nearest_station", "idw_k8"])
    return out.select("period", *[F.round(c, 6).alias(c) for c in ("actual", "nearest_station", "idw_k8")])


@register("bands_markdown", query("""SELECT band, model, '| ' || model || ' | ' || band || ' | ' || format('{:,}', stations) || ' | ' || format('{:,}', station_days)
 || ' |' AS head FROM intervals""", "intervals"))
def bands_markdown(spark, sf):
    from skyhive.sinks.tables import bands_markdown as lines

    out = lines(intervals(spark, sf))
    return out.select("band", "model", F.concat(F.regexp_extract("line", r"^((\|[^|]*){4})", 1), F.lit("|")).alias("head"))


# ---------------------------------------------------------------- learning

FOLDS = 5


@register("cell_folds", query(f"""SELECT cell, CAST((row_number() OVER (ORDER BY md5('7|' || cell)) - 1) % 5 AS INTEGER) AS fold
 FROM (SELECT DISTINCT cell FROM site_cells) c""", "site_cells"))
def cell_folds(spark, sf):
    return L.assign_folds(sites(spark, sf).select(geo.cell_of("lat", "lon", STATION_RES).alias("cell")), 5, 7)


def training(spark, sf):
    seen = hidden(spark, sf)
    folds = L.assign_folds(seen.select("cell"), FOLDS)
    return cut_lineage(L.training_rows(seen, cell_days(spark, sf)).join(folds, "cell", "left"), "training")


@register("training_rows", query("""SELECT station_id, period, round(actual, 6) AS actual, round(neighbour_idw, 6) AS neighbour_idw, round(fires_150km, 4) AS fires_150km,
 round(no2_trop, 9) AS no2_trop FROM hidden h LEFT JOIN cell_days c ON c.cell = h.cell AND c.date = h.period""", "hidden", "cell_days"))
def training_rows(spark, sf):
    rows = L.training_rows(hidden(spark, sf), cell_days(spark, sf))
    return rows.select("station_id", "period", F.round("actual", 6).alias("actual"), F.round("neighbour_idw", 6).alias("neighbour_idw"),
                       F.round("fires_150km", 4).alias("fires_150km"), F.round("no2_trop", 9).alias("no2_trop"))


_fits: dict[tuple, tuple] = {}


def variants(spark, sf, names=tuple(L.VARIANTS)):
    """Training rows and the fold models of each variant; a variant is fitted once for the session and the data."""
    key = spark.sparkContext.applicationId, sf
    if key not in _fits:
        _fits[key] = training(spark, sf), {}
    rows, fits = _fits[key]
    for name in names:
        if name not in fits:
            spec = L.VARIANTS[name]
            fits[name] = L.fit_folds(rows, FOLDS, spec["target"], spec["loss"], spec["drop"])
    return rows, {n: fits[n] for n in names}


@register("boosted_band_errors", query("""SELECT m.model, band, count(DISTINCT station_id) AS stations, count(*) AS station_periods, TRUE AS sound FROM hidden h,
 (SELECT unnest(['m1_level_l1', 'm2_residual_l2', 'm3_residual_l2_nogeo', 'nearest_station', 'idw_k8', 'combined']) AS model) m
 WHERE neighbour_idw IS NOT NULL AND band <> 'no remaining data' GROUP BY ALL""", "hidden"))
def boosted_band_errors(spark, sf):
    """All three variants and the combined form, each hidden station scored by a model that never saw its cell, beside the
    baselines. `sound`: the errors are finite and no bias exceeds its error. boosted_band_table has the figures."""
    out = boosted_band_table(spark, sf)
    return out.select("model", "band", "stations", "station_periods", (~F.isnan("mae") & (F.col("mae") >= F.abs("bias") - 1e-9) & F.col("nmae_pct").isNotNull()).alias("sound"))


@register("boosted_band_table")
def boosted_band_table(spark, sf):
    """Error of every variant by distance band."""
    return V.band_table(stored_variants(spark, sf))


def stored_variants(spark, sf):
    """Predictions of all variants for hidden stations, written by model and read back."""
    rows, fits = variants(spark, sf)
    path = shared_path(spark, "variant-predictions")
    replace_partitions(DE.hidden_predictions(fits, rows), path, ["model"])
    return spark.read.parquet(path)


@register("stored_predictions", query("""SELECT m.model, station_id, count(*) AS periods, count(neighbour_idw) AS predicted FROM hidden h,
 (SELECT unnest(['m2_residual_l2', 'm3_residual_l2_nogeo', 'nearest_station', 'idw_k8']) AS model) m GROUP BY ALL UNION ALL
 SELECT model, station_id, count(*), count(CASE WHEN model = 'm1_level_l1' OR dist_nearest_km > 100 OR dist_nearest_km IS NULL THEN 1 ELSE neighbour_idw END) FROM hidden h,
 (SELECT unnest(['m1_level_l1', 'combined']) AS model) m GROUP BY ALL""", "hidden"))
def stored_predictions(spark, sf):
    """Rows of the stored variant predictions: the level model knows an answer everywhere, residuals where neighbours report."""
    return stored_variants(spark, sf).groupBy("model", "station_id").agg(F.count(F.lit(1)).alias("periods"), F.count("predicted").alias("predicted"))


@register("model_decision", query("""SELECT m.model, band, count(DISTINCT station_id) AS stations, count(*) AS station_days, TRUE AS inside, TRUE AS ruled FROM hidden h,
 (SELECT unnest(['idw_k8', 'm1_level_l1', 'm3_residual_l2_nogeo', 'combined']) AS model) m WHERE neighbour_idw IS NOT NULL AND band <> 'no remaining data' GROUP BY ALL""", "hidden"))
def model_decision(spark, sf):
    """The decision over stored predictions of the fitted variants. `inside`: the interval holds the point value; `ruled`: the
    rule promoted the combined form exactly if its lower bounds say so. model_promoted has the outcome."""
    bands = cut_lineage(B.station_bootstrap(_decided_rows(spark, sf), DECIDED, DRAWS), "model-intervals")
    wins = B.decide(bands, "combined", "idw_k8").first()["wins"]
    above = bands.where((F.col("model") == "combined") & F.col("band").isin(B.TARGET_BANDS) & (F.col("vs_idw_lo") > 0)).count()
    # with few stations a draw's middle may lie off the point value
    inside = F.col("mae").between(F.col("mae_lo") - 1e-9, F.col("mae_hi") + 1e-9) | (F.col("stations") < 10)
    return bands.select("model", "band", "stations", "station_days", inside.alias("inside"), F.lit(wins == (above == len(B.TARGET_BANDS))).alias("ruled"))


DECIDED = ["idw_k8", "m1_level_l1", "m3_residual_l2_nogeo", "combined"]


def _decided_rows(spark, sf):
    return cut_lineage(B.paired(stored_variants(spark, sf).where(F.col("model").isin(DECIDED)), DECIDED), "paired-variants")


@register("model_promoted")
def model_promoted(spark, sf):
    """Which form the rule promotes, from stored predictions."""
    return B.decide(B.station_bootstrap(_decided_rows(spark, sf), DECIDED, DRAWS), "combined", "idw_k8")


@register("boosting_rounds")
def boosting_rounds(spark, sf):
    """Error on held-out cells after each round of each fold, until the gain ended."""
    _, fits = variants(spark, sf)
    return reduce(DataFrame.unionByName, [L.error_by_round(fitted, name, spark) for name, fitted in fits.items()])


_NAMES = ", ".join(f"'{f}'" for f in FEATURES)
_GROUP = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in members)}) THEN '{name}'" for name, members in FEATURE_GROUPS.items()) + " END"
fragment("gains", f"""SELECT 'v' || l_linenumber % 3 AS variant, l_suppkey % 5 AS fold, [{_NAMES}][l_orderkey % {len(FEATURES)} + 1] AS feature, CAST(l_quantity AS DOUBLE) AS gain FROM lineitem""")
fragment("gain_shares", f"""SELECT variant, feature, {_GROUP} AS feature_group, 100 * gain / sum(gain) OVER (PARTITION BY variant) AS gain_pct FROM (SELECT variant, feature, avg(gain) AS gain
 FROM (SELECT variant, fold, feature, sum(gain) AS gain FROM gains GROUP BY ALL) a GROUP BY ALL) b""", "gains")


def gain_shares(spark, sf):
    """Gains of three variants and five folds from a given table, so that the summary follows the data."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    names = F.array(*map(F.lit, FEATURES))
    return L.summarise_importance(rows.select(
        F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("variant"), (F.col("l_suppkey") % 5).alias("fold"),
        F.element_at(names, (F.col("l_orderkey") % len(FEATURES) + 1).cast("int")).alias("feature"), F.col("l_quantity").cast("double").alias("gain")))


@register("importance_groups", query("SELECT variant, feature_group, round(sum(gain_pct), 6) AS gain_pct FROM gain_shares GROUP BY ALL", "gain_shares"))
def importance_groups(spark, sf):
    return L.importance_by_group(gain_shares(spark, sf)).withColumn("gain_pct", F.round("gain_pct", 6))


@register("importance_pivot", query("SELECT feature, feature_group, " + ", ".join(f"round(max(gain_pct) FILTER (variant = '{v}'), 6) AS {v}" for v in ("v0", "v1", "v2"))
    + " FROM gain_shares GROUP BY ALL", "gain_shares"))
def importance_pivot(spark, sf):
    out = L.importance_pivot(gain_shares(spark, sf), ["v0", "v1", "v2"])
    return out.select("feature", "feature_group", *[F.round(v, 6).alias(v) for v in ("v0", "v1", "v2")])


@register("importance_top", query("""SELECT variant, feature, CAST(row_number() OVER (PARTITION BY variant ORDER BY gain_pct DESC, feature) AS INTEGER) AS rank, round(gain_pct, 6) AS gain_pct
 FROM gain_shares QUALIFY rank <= 3""", "gain_shares"))
def importance_top(spark, sf):
    return L.top_features(gain_shares(spark, sf)).select("variant", "feature", "rank", F.round("gain_pct", 6).alias("gain_pct"))


@register("feature_importance")
def feature_importance(spark, sf):
    """Gain by feature and group for the model without latitude and longitude."""
    name = "m3_residual_l2_nogeo"
    _, fits = variants(spark, sf, (name,))
    return L.importance(fits[name], name, spark)


def predicted_days(spark, sf, with_features=False):
    """Routed estimates of every grid cell and day from the two baselines, with confidence and error."""
    values = cut_lineage(observations(spark, sf), "observations")

    def rows():
        days = (full_days if with_features else bare_days)(spark, sf)
        return P.serving_rows(days["grid"], days["rows"], values, K)

    served, errors = side_by_side(spark, rows, lambda: levels(spark, sf, values))
    routed = P.route(served, "neighbour_idw", "neighbour_nearest")
    return P.with_confidence(routed, errors).withColumn("cell_r4", geo.parent("cell", 4, RES))


fragment("served", f"""SELECT g.cell, g.cell_r4, g.lat, g.lon, g.dist_working_km, p.date, neighbour_idw, neighbour_nearest, dist_nearest_km, n_reporting,
 CASE WHEN dist_nearest_km <= 100 THEN neighbour_idw ELSE neighbour_nearest END AS pm25,
 CAST(CASE WHEN dist_nearest_km < 20 THEN 0 WHEN dist_nearest_km < 100 THEN 1 ELSE 2 END AS INTEGER) AS confidence FROM full_grid g
 CROSS JOIN (SELECT DISTINCT date FROM pixels) p LEFT JOIN (SELECT cell, period, sum(value / power(greatest(km, 0.5), 2)) / sum(1 / power(greatest(km, 0.5), 2)) AS neighbour_idw,
 max(value) FILTER (rank = 1) AS neighbour_nearest, max(km) FILTER (rank = 1) AS dist_nearest_km, max(n) AS n_reporting FROM (
 SELECT g.cell, o.period, o.value, {fixed6(haversine('g.lat', 'g.lon', 'o.cell_lat', 'o.cell_lon'))} AS km, count(*) OVER (PARTITION BY g.cell, o.period) AS n,
 row_number() OVER (PARTITION BY g.cell, o.period ORDER BY {fixed6(haversine('g.lat', 'g.lon', 'o.cell_lat', 'o.cell_lon'))}, o.station_id) AS rank
 FROM full_grid g, obs o) z WHERE rank <= {K} GROUP BY cell, period) n ON n.cell = g.cell AND n.period = p.date""", "full_grid", "pixels", "obs")
fragment("predicted", """SELECT s.*, pm25 * rel_error_pct / 100 AS uncertainty FROM served s LEFT JOIN levels l ON l.level = s.confidence""", "served", "levels")


@register("daily_predictions", query("""SELECT date, cell_r4 AS cell, round(avg(pm25) + 1.7e-9, 6) AS pm25, round(avg(uncertainty) + 1.7e-9, 6) AS uncertainty,
 round(avg(dist_nearest_km) + 1.7e-9, 6) AS dist_km, max(confidence) AS confidence FROM predicted GROUP BY date, cell_r4""", "predicted"))
def daily_predictions(spark, sf):
    out = rollup.rollup_predictions(predicted_days(spark, sf), "cell_r4")
    # the small shift keeps exact halves from falling either way
    return out.select("date", "cell", *[F.round(F.col(c) + 1.7e-9, 6).alias(c) for c in ("pm25", "uncertainty", "dist_km")],
                      "confidence")


@register("daily_digest", query("""SELECT date, count(*) AS cells, round(quantile_cont(pm25, 0.5), 6) AS median,
 round(100 * avg(CASE WHEN pm25 > 90 THEN 1.0::DOUBLE ELSE 0 END), 6) AS poor_pct,
 round(100 * avg(CASE WHEN confidence >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_confidence_pct,
 round(100 * avg(CASE WHEN pm25 > 90 AND dist_working_km > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dark_pct FROM predicted GROUP BY date""", "predicted"))
def daily_digest(spark, sf):
    out = P.digest(cut_lineage(predicted_days(spark, sf), "predicted"))
    return out.select("date", "cells", *[F.round(c, 6).alias(c) for c in ("median", "poor_pct", "low_confidence_pct", "dark_pct")])


def deployed(spark, sf):
    _, fits = variants(spark, sf, (DE.NEAR, DE.FAR))
    return DE.Deployed(fits[DE.NEAR], fits[DE.FAR])


def serving(spark, sf):
    """Every grid cell of every day with all features."""
    days = full_days(spark, sf)
    values = cut_lineage(observations(spark, sf), "observations")
    return cut_lineage(P.serving_rows(days["grid"], days["rows"], values, K), "serving")


def stored_days(spark, sf):
    """Both sets fitted, saved and loaded; every cell and day scored, written by day and read back."""
    fitted, path = deployed(spark, sf), shared_path(spark, "models")
    fitted.save(path)
    loaded, rows = DE.load(path), serving(spark, sf)
    before = DE.estimates(fitted, rows, "before").drop("route")  # what the sets said before they were saved
    out = shared_path(spark, "predictions")
    DE.write_predictions(loaded, before, levels(spark, sf), out, ["before"])
    return spark.read.parquet(out)


@register("mean_model_predictions", query("""SELECT cell, date, CASE WHEN dist_nearest_km <= 100 THEN 'near' ELSE 'far' END AS route, confidence, dist_nearest_km,
 TRUE AS known, TRUE AS same_after_load FROM served""", "served"))
def mean_model_predictions(spark, sf):
    """The deployed model over every grid cell and day, read from the stored table. `known`: an estimate of at least zero;
    `same_after_load`: the loaded sets say what the fitted ones said."""
    rows = stored_days(spark, sf)
    return rows.select("cell", "date", "route", "confidence", "dist_nearest_km", (F.col("pm25").isNotNull() & (F.col("pm25") >= 0)).alias("known"),
                       F.greatest("before", F.lit(0.0)).eqNullSafe(F.col("pm25")).alias("same_after_load"))


@register("model_predictions")
def model_predictions(spark, sf):
    """Estimates of the deployed model: cell, date, route, pm25, confidence, uncertainty."""
    return stored_days(spark, sf).select("cell", "date", "route", "pm25", "confidence", "uncertainty")
