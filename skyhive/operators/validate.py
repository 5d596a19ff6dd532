"""Leave-station-out validation: estimates for hidden stations, scores per station and per distance band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyhive.functions.scales import BAND_NAMES, NO_BAND, distance_band, pm25_class
from skyhive.operators.neighbours import nearest_sites, neighbour_features, station_cells
from skyhive.operators.scale import exact_quantiles
from skyhive.session import cut_lineage

BASELINES = {"neighbour_nearest": "nearest_station", "neighbour_idw": "idw_k8"}


def observations(daily: DataFrame, stations: DataFrame, res: int) -> DataFrame:
    """Station values with the cell each station stands in."""
    return daily.select("station_id", "period", "value").join(
        station_cells(stations, res).select("station_id", "cell", "cell_lat", "cell_lon"), "station_id")


def hidden_features(values: DataFrame, targets: DataFrame | None = None, k: int = 8) -> DataFrame:
    """One row per target station and period: what the remaining stations say about its cell.

    Every station of the target's cell is hidden, so none of its readings can reach its own features.
    """
    asked = values if targets is None else values.join(targets.select("station_id"), "station_id", "left_semi")
    features = neighbour_features(asked, values, k)
    return (asked.join(features, ["cell", "period"], "left")
            .withColumnRenamed("value", "actual")
            .withColumn("band", distance_band("dist_nearest_km")))


def per_period(features: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Long form: one row per station, model and period."""
    models = models or BASELINES
    entries = F.array(*[F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("predicted"))
                        for column, name in models.items()])
    return features.select(
        "station_id", "period", F.col("dist_nearest_km").alias("nearest_reporting_km"), "band", "actual",
        F.explode(entries).alias("m")).select(
        "station_id", "m.model", "period", "nearest_reporting_km", "band", "actual", "m.predicted")


def same_class(actual="actual", predicted="predicted") -> Column:
    return (pm25_class(actual) == pm25_class(predicted)).cast("double")


def per_station(periods: DataFrame, stations: DataFrame, cover: DataFrame, res: int) -> DataFrame:
    """Scores of each hidden station and model. Correlation needs three periods and some variance on both sides."""
    scored = F.col("predicted").isNotNull()
    error, actual, predicted = (F.when(scored, c) for c in (
        F.col("predicted") - F.col("actual"), F.col("actual"), F.col("predicted")))
    varied = ((F.count(error) > 2) & (F.min(actual) < F.max(actual)) & (F.min(predicted) < F.max(predicted)))
    middle = F.expr("percentile(nearest_reporting_km, 0.5D)")  # one value per period of one station
    scores = periods.groupBy("station_id", "model").agg(
        F.count(F.lit(1)).alias("periods"), F.count(error).alias("predicted"),
        F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(varied, F.corr(actual, predicted)).alias("r"), F.avg(actual).alias("actual_mean"),
        F.avg(F.when(scored, same_class())).alias("category_agreement"),
        middle.alias("median_nearest_reporting_km"))
    placed = station_cells(stations, res).select("station_id", "cell", "cell_lat", "cell_lon")
    crowd = placed.groupBy("cell").agg((F.count(F.lit(1)) - 1).alias("hidden_in_same_hex"))
    spots = placed.select("cell", "cell_lat", "cell_lon").distinct()
    nearest = nearest_sites(
        spots.select(F.col("cell").alias("target"), F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")),
        spots.select(F.col("cell").alias("site"), F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")),
        1, skip_same=True).select(F.col("target").alias("cell"), F.col("km").alias("nearest_remaining_km"))
    about = placed.join(crowd, "cell").join(nearest, "cell", "left").select(
        "station_id", "hidden_in_same_hex", "nearest_remaining_km")
    return (scores.join(about, "station_id", "left")
            .join(cover.select("station_id", "coverage"), "station_id", "left")
            .withColumn("band", distance_band("median_nearest_reporting_km")))


def _station_errors(periods: DataFrame) -> DataFrame:
    """Sums of errors of each model, band and station."""
    done = periods.where(F.col("predicted").isNotNull() & F.col("band").isin(BAND_NAMES))
    error = F.col("predicted") - F.col("actual")
    return done.groupBy("model", "band", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(error)).alias("sae"), F.sum(error).alias("se"),
        F.sum("actual").alias("sa"), F.sum(same_class()).alias("hits"))


def _band_means(by_station: DataFrame) -> DataFrame:
    return by_station.groupBy("model", "band").agg(
        F.count(F.lit(1)).alias("stations"), F.sum("n").cast("bigint").alias("station_periods"),
        (F.sum("sae") / F.sum("n")).alias("mae"), (100 * F.sum("sae") / F.sum("sa")).alias("nmae_pct"),
        (F.sum("se") / F.sum("n")).alias("bias"), (F.sum("sa") / F.sum("n")).alias("actual_mean"),
        (100 * F.sum("hits") / F.sum("n")).alias("category_agreement_pct"))


def band_errors(periods: DataFrame) -> DataFrame:
    """The band table without the median over stations: one pass, for those who read no median."""
    return _band_means(_station_errors(periods))


def band_table(periods: DataFrame) -> DataFrame:
    """Error of each model in each distance band; bands are never blended into one number."""
    by_station = cut_lineage(_station_errors(periods), "station-errors")  # read three times
    middle = exact_quantiles(by_station.withColumn("station_mae", F.col("sae") / F.col("n")),
                             ["model", "band"], "station_mae", {"median_station_mae": 0.5}).drop("n")
    return _band_means(by_station).join(middle, ["model", "band"], "left")


def improvement(bands: DataFrame, baseline: str = "idw_k8") -> DataFrame:
    """Change of every model against the baseline, band by band; positive is better."""
    base = bands.where(F.col("model") == baseline).select(
        "band", F.col("mae").alias("baseline_mae"), F.col("nmae_pct").alias("baseline_nmae_pct"))
    gain = F.col("baseline_mae") - F.col("mae")
    return (bands.where(F.col("model") != baseline).join(base, "band")
            .select("model", "band", "station_periods", "baseline_mae", F.col("mae").alias("model_mae"),
                    gain.alias("mae_improvement"), (100 * gain / F.col("baseline_mae")).alias("mae_improvement_pct"),
                    "baseline_nmae_pct", F.col("nmae_pct").alias("model_nmae_pct")))


def series_of(periods: DataFrame, station_id: str, models: list[str]) -> DataFrame:
    """One station day by day: actual beside each model. Days nobody reported stay as gaps."""
    mine = periods.where(F.col("station_id") == station_id)
    wide = mine.groupBy("period").agg(
        F.max("actual").alias("actual"),
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models])
    span = wide.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    days = span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("period"))
    return days.join(wide, "period", "left")


def nearest_remaining(stations: DataFrame, cover: DataFrame, station_ids: list[str], res: int, k: int = 5) -> DataFrame:
    """The k nearest stations outside each listed station's cell, with distance and coverage."""
    placed = station_cells(stations, res)
    chosen = placed.where(F.col("station_id").isin(station_ids)).select(
        F.col("station_id").alias("target"), F.col("cell").alias("own"),
        F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))
    spots = placed.select("cell", "cell_lat", "cell_lon").distinct().select(
        F.col("cell").alias("site"), F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))
    cells = chosen.select(F.col("own").alias("target"), "lat", "lon").distinct()
    # k other cells hold at least k stations
    lists = nearest_sites(cells, spots, k, skip_same=True)
    members = placed.select(F.col("cell").alias("site"), "station_id")
    order = Window.partitionBy("target").orderBy("km", "station_id")
    ranked = (chosen.select("target", "own")
              .join(lists.select(F.col("target").alias("own"), "site", "km"), "own").join(members, "site")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return ranked.join(cover.select("station_id", "coverage"), "station_id", "left").select(
        "target", "rank", "station_id", "km", "coverage")


def missing_days(present: DataFrame, start, end) -> DataFrame:
    """Days of a range that a table has no row for."""
    days = present.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.join(present.select("date").distinct(), "date", "left_anti")
