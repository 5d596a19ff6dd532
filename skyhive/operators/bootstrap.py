"""Paired comparisons with bootstrap intervals, by station and by blocks of days; and the decision rule."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.operators.scale import digest_rank
from skyhive.functions.scales import BAND_CONFIDENCE, BAND_NAMES, CONFIDENCE_NAMES, pm25_class

# Fixed values
DRAWS = 2000
BLOCK_DAYS = 7
THRESHOLD_KM = 100.0
TARGET_BANDS = ["20-50 km", "100 km+"]
BASELINE_KEYS = {"idw_k8": "vs_idw", "nearest_station": "vs_nearest"}


def paired(periods: DataFrame, models: list[str]) -> DataFrame:
    """One row per station-period that every listed model predicted, one column per model."""
    rows = periods.where(F.col("model").isin(models) & F.col("band").isin(BAND_NAMES))
    wide = rows.groupBy("station_id", "period", "band").agg(
        F.max("actual").alias("actual"),
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models])
    return wide.dropna(subset=models)


def combine(periods: DataFrame, near: str, far: str, name: str = "combined",
            threshold_km: float = THRESHOLD_KM) -> DataFrame:
    """The near model where a station reports within the threshold, the far model elsewhere and where unknown."""
    use_near = F.coalesce(F.col("nearest_reporting_km") <= threshold_km, F.lit(False))
    both = periods.where(F.col("model").isin(near, far)).groupBy("station_id", "period").agg(
        *[F.max(F.when(F.col("model") == near, F.col(c))).alias(c)
          for c in ("nearest_reporting_km", "band", "actual")],
        F.max(F.when(F.col("model") == near, F.lit(True))).alias("has_near"),
        F.max(F.when(F.col("model") == near, F.col("predicted"))).alias("p_near"),
        F.max(F.when(F.col("model") == far, F.col("predicted"))).alias("p_far"))
    return both.where("has_near").select(
        "station_id", F.lit(name).alias("model"), "period", "nearest_reporting_km", "band", "actual",
        F.when(use_near, F.col("p_near")).otherwise(F.col("p_far")).alias("predicted"),
        F.when(use_near, F.lit(near)).otherwise(F.lit(far)).alias("component"))


def pick(seed, draw, slot, n) -> Column:
    """A number 0..n-1 from a digest of (seed, draw, slot): the same on every run and every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % n


def station_sums(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.groupBy("station_id", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").alias("actual"),
        *[F.sum(F.abs(F.col(m) - F.col("actual"))).alias(m) for m in models])


def station_draws(stations: DataFrame, draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Picks (draw, pos) with repeats, as many per draw as there are stations, and the station at each pos."""
    total = stations.agg(F.count(F.lit(1)).alias("n")).scalar()
    indexed = digest_rank(stations.select("station_id"), "station_id")
    # One row per slot, spread over the cluster, then one per slot and draw. The slots are few bytes, the picks are not:
    # without a number the shuffle would be merged into one task that makes them all.
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = indexed.select(F.col("pos").alias("slot")).repartition(tasks, "slot").withColumn("n", total)
    picks = (slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
             .select("draw", pick(seed, F.col("draw"), F.col("slot"), F.col("n")).alias("pos")))
    return picks, indexed


def station_bootstrap(wide: DataFrame, models: list[str], draws: int = DRAWS, seed: int = 0,
                      ci: float = 95.0) -> DataFrame:
    """Pooled error per model and band with an interval from redrawing whole stations.

    All models and bands share the draws, so comparisons are paired. Readings are summed per station first; picks go
    to the task that holds their station's sums and are added up there, so only totals per draw and band go on. The
    planner takes the picks for as small as the slots they come from, hence the hint: the sums are what is looked up.
    """
    sums = station_sums(wide, models)
    picks, indexed = station_draws(wide.select("station_id").distinct(), draws, seed)
    held = sums.join(indexed, "station_id").select("pos", "band", "n", *models)
    weighted = (picks.join(held.hint("shuffle_hash"), "pos").groupBy("draw", "band").agg(
        F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in models]))
    low, high = (100 - ci) / 200, 1 - (100 - ci) / 200

    def entry(m: str) -> Column:
        parts = [F.lit(m).alias("model"), (F.col(m) / F.col("n")).alias("mae")]
        for base, key in BASELINE_KEYS.items():
            gain = 100 * F.try_divide(F.col(base) - F.col(m), F.col(base)) if base in models and base != m \
                else F.lit(None).cast("double")
            parts.append(gain.alias(key))
        return F.struct(*parts)

    drawn = weighted.select("band", F.explode(F.array(*[entry(m) for m in models])).alias("e")).select("band", "e.*")
    # exact percentiles over at most `draws` values per group
    bounds = drawn.groupBy("band", "model").agg(*[
        F.expr(f"percentile({c}, {q!r}D)").alias(f"{c}_{side}")
        for c in ("mae", *BASELINE_KEYS.values()) for side, q in (("lo", low), ("hi", high))])
    pooled = sums.groupBy("band").agg(
        F.count(F.lit(1)).alias("stations"), F.sum("n").alias("n"), F.sum("actual").alias("actual"),
        *[F.sum(m).alias(m) for m in models])

    def point(m: str) -> Column:
        parts = [F.lit(m).alias("model"), (F.col(m) / F.col("n")).alias("mae"),
                 (100 * F.col(m) / F.col("actual")).alias("nmae_pct")]
        for base, key in BASELINE_KEYS.items():
            gain = 100 * (F.col(base) - F.col(m)) / F.col(base) if base in models and base != m \
                else F.lit(None).cast("double")
            parts.append(gain.alias(f"{key}_pct"))
        return F.struct(*parts)

    points = pooled.select("band", "stations", F.col("n").cast("bigint").alias("station_days"),
                           F.explode(F.array(*[point(m) for m in models])).alias("e")).select(
        "band", "stations", "station_days", "e.*")
    return points.join(bounds, ["band", "model"], "left")


def paired_improvement(wide: DataFrame, model: str, reference: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Per band, how much one model improves on another, with an interval on the same draws, and a verdict."""
    two = wide.select("station_id", "period", "band", "actual", F.col(model).alias("candidate"),
                      F.col(reference).alias("idw_k8"))
    result = station_bootstrap(two, ["idw_k8", "candidate"], draws, seed).where("model = 'candidate'")
    verdict = F.when(F.col("vs_idw_lo") > 0, "yes").when(F.col("vs_idw_hi") < 0, "worse").otherwise("not established")
    return result.select("band", "stations", "station_days", F.col("vs_idw_pct").alias("improvement_pct"),
                         F.col("vs_idw_lo").alias("lo"), F.col("vs_idw_hi").alias("hi"), verdict.alias("clearly_better"),
                         F.lit(model).alias("model"), F.lit(reference).alias("reference"))


def _scores(models: list[str], group: list[str], rows: DataFrame) -> DataFrame:
    same = lambda m: (pm25_class("actual") == pm25_class(m)).cast("double")
    parts = []
    for m in models:
        parts += [F.avg(F.abs(F.col(m) - F.col("actual"))).alias(f"mae_{m}"),
                  F.avg(F.col(m) - F.col("actual")).alias(f"bias_{m}"),
                  F.corr("actual", m).alias(f"r_{m}"), F.avg(same(m)).alias(f"category_{m}")]
    return (rows.groupBy(*group) if group else rows.groupBy()).agg(F.count(F.lit(1)).alias("days"), *parts)


def block_starts(draws: int, blocks: int, seed: int) -> np.ndarray:
    """The digest numbers of pick() for every draw and block: the same for all series."""
    numbers = [int(md5(f"{seed}|{draw}|{block}".encode()).hexdigest()[:7], 16) for draw in range(draws) for block in range(blocks)]
    return np.array(numbers, np.int64).reshape(draws, blocks)


def _between(values: np.ndarray, share: float) -> float | None:
    """Exact quantile by linear interpolation."""
    if not len(values):
        return None
    at = share * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    below, above = np.partition(values, (low, high))[[low, high]].tolist()
    return below if below == above else below + (above - below) * (at - low)


def block_intervals(days: dict[str, np.ndarray], models: list[str], baseline: str, digests: np.ndarray, block_days: int,
                    bounds: tuple[float, float]) -> dict[str, list[float]]:
    """Bounds of one series. days: actual, each model and whether it hits the class (`same_<model>`), in the order of days.

    Sums over a block are differences of running sums; a draw adds its blocks, the last of which may be shorter. Products
    are of deviations from the series' own means, so correlations do not lose digits.
    """
    n, blocks = len(days["actual"]), digests.shape[1]
    start = digests % (max(n - block_days, 0) + 1)
    length = np.full(blocks, block_days)
    length[-1] = n - (blocks - 1) * block_days

    def drawn(values):
        ahead = np.add.reduce(np.lib.stride_tricks.sliding_window_view(np.append(values, np.zeros(block_days - 1)), block_days), axis=1)
        last = np.add.reduce(np.lib.stride_tricks.sliding_window_view(values, length[-1]), axis=1)
        return ahead[start[:, :-1]].sum(axis=1) + last[start[:, -1]]

    y = days["actual"] - days["actual"].mean()
    total_y, total_yy = drawn(y), drawn(y * y)
    found = {f"{c}_{side}": [] for c in ("mae", "r", "category", "vs_idw") for side in ("lo", "hi")}
    mae = {m: drawn(np.abs(days[m] - days["actual"])) / n for m in models}
    for m in models:
        x = days[m] - days[m].mean()
        total_x = drawn(x)
        across = drawn(x * y) - total_x * total_y / n
        spread = (drawn(x * x) - total_x * total_x / n) * (total_yy - total_y * total_y / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(spread > 1e-12, across / np.sqrt(spread), np.nan)
            gain = np.where(mae[baseline] == 0, np.nan, 100 * (mae[baseline] - mae[m]) / mae[baseline]) if m != baseline else np.zeros(0)
        for name, values in (("mae", mae[m]), ("r", r), ("category", drawn(days[f"same_{m}"]) / n), ("vs_idw", gain)):
            finite = values[~np.isnan(values)]  # draws without a finite value are skipped, such as a correlation over constant days
            for side, share in zip(("lo", "hi"), bounds):
                found[f"{name}_{side}"].append(_between(finite, share))
    return found


def block_bootstrap(series: DataFrame, models: list[str], baseline: str = "idw_k8", draws: int = DRAWS,
                    block_days: int = BLOCK_DAYS, seed: int = 0, ci: float = 95.0, by: str = "station_id") -> DataFrame:
    """Intervals for each station's own series from redrawing blocks of consecutive days.

    A series is one station's days, at most one row per calendar day, so a task holds it whole; the series are shuffled
    once. Picks depend on draw, block and length alone, so no pick is ever a row.
    """
    bounds = ((100 - ci) / 200, 1 - (100 - ci) / 200)
    names = [f"{c}_{side}" for c in ("mae", "r", "category", "vs_idw") for side in ("lo", "hi")]
    same = [(pm25_class("actual") == pm25_class(m)).cast("double").alias(f"same_{m}") for m in models]
    rows = series.select(by, "period", F.col("actual").cast("double").alias("actual"), *[F.col(m).cast("double").alias(m) for m in models], *same)
    columns = ["actual", *models, *(f"same_{m}" for m in models)]
    digests: dict[int, np.ndarray] = {}  # by number of blocks

    def intervals(table: pa.Table) -> pa.Table:
        table = table.sort_by("period")
        blocks = -(-table.num_rows // block_days)
        if blocks not in digests:
            digests[blocks] = block_starts(draws, blocks, seed)
        days = {c: np.nan_to_num(table.column(c).to_numpy(), nan=0.0) if c.startswith("same_") else table.column(c).to_numpy() for c in columns}
        found = block_intervals(days, models, baseline, digests[blocks], block_days, bounds)
        key = pa.array(table.column(by).to_pylist()[:1] * len(models), table.schema.field(by).type)
        return pa.table({by: key, "model": pa.array(models)} | {c: pa.array(found[c], pa.float64()) for c in names})

    kind = series.schema[by].dataType.simpleString()
    drawn = rows.groupBy(by).applyInArrow(intervals, f"{by} {kind}, model string, " + ", ".join(f"{c} double" for c in names))

    def entry(m: str) -> Column:
        gain = 100 * F.try_divide(F.col(f"mae_{baseline}") - F.col(f"mae_{m}"), F.col(f"mae_{baseline}")) \
            if m != baseline else F.lit(None).cast("double")
        return F.struct(F.lit(m).alias("model"), *[F.col(f"{s}_{m}").alias(s) for s in ("mae", "bias", "r", "category")],
                        gain.alias("vs_idw"))

    points = _scores(models, [by], rows).select(by, "days", F.explode(F.array(*[entry(m) for m in models])).alias("e")).select(by, "days", "e.*")
    return points.join(drawn, [by, "model"], "left")


def decide(bands: DataFrame, candidate: str, fallback: str, target_bands: list[str] | None = None) -> DataFrame:
    """The candidate wins only if its lower bound against the baseline is above zero in every target band."""
    target_bands = target_bands or TARGET_BANDS
    wanted = bands.where((F.col("model") == candidate) & F.col("band").isin(target_bands))
    checks = wanted.agg(F.count(F.lit(1)).alias("seen"),
                        F.coalesce(F.bool_and(F.coalesce(F.col("vs_idw_lo") > 0, F.lit(False))), F.lit(False)).alias("all_above"))
    wins = F.col("all_above") & (F.col("seen") == len(target_bands))
    return checks.select(wins.alias("wins"), F.when(wins, candidate).otherwise(fallback).alias("promoted"))


def confidence_levels(bands: DataFrame, model: str) -> DataFrame:
    """Relative error of each confidence level: its bands pooled by station-days."""
    level = F.create_map(*[F.lit(v) for pair in BAND_CONFIDENCE.items() for v in pair])
    rows = bands.where(F.col("model") == model).withColumn("level", level[F.col("band")])
    names = F.array(*[F.lit(n) for n in CONFIDENCE_NAMES])
    return (rows.groupBy("level").agg(
        F.bround(F.sum(F.col("nmae_pct") * F.col("station_days")) / F.sum("station_days"), 1).alias("rel_error_pct"))
        .withColumn("label", F.element_at(names, F.col("level") + 1)))

