"""The deployed model: a near and a far set of fold models that are saved together, loaded, and score every cell and day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhive.operators import learn
from skyhive.operators.bootstrap import THRESHOLD_KM
from skyhive.operators.predict import route, with_confidence
from skyhive.operators.validate import BASELINES, per_period
from skyhive.sinks.tables import replace_partitions

NEAR, FAR = "m3_residual_l2_nogeo", "m1_level_l1"
# Fixed value: the near model serves up to this distance from a reporting station
NEAR_KM = 100.0


@dataclass
class Deployed:
    near: learn.Fitted
    far: learn.Fitted

    def save(self, path: str) -> None:
        learn.save(self.near, f"{path}/near")
        learn.save(self.far, f"{path}/far")


def load(path: str) -> Deployed:
    return Deployed(learn.restore(f"{path}/near"), learn.restore(f"{path}/far"))


def estimates(deployed: Deployed, rows: DataFrame, name: str = "estimate") -> DataFrame:
    """rows: FEATURES and dist_nearest_km -> the mean of the near or the far fold models, and which of them (`route`).

    Where no station reports, the distance is unknown and the far set serves: the near one adds to what neighbours
    say. Scoring needs no shuffle, each row meets all fold models in its task.
    """
    both = learn.predict_mean(deployed.far, learn.predict_mean(deployed.near, rows, "_near"), "_far")
    named = both.withColumn("_near_name", F.lit("near")).withColumn("_far_name", F.lit("far"))
    return route(route(named, "_near", "_far", NEAR_KM, name), "_near_name", "_far_name", NEAR_KM, "route").drop("_near", "_far", "_near_name", "_far_name")


def write_predictions(deployed: Deployed, rows: DataFrame, levels: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Estimates with confidence and error of all rows, one partition a day; days already there are replaced."""
    out = with_confidence(estimates(deployed, rows), levels)
    keep = ["cell", "date", "route", "pm25", "confidence", "uncertainty", "dist_nearest_km", "dist_working_km", *(columns or [])]
    replace_partitions(out.select(*keep), path, ["date"])


def hidden_predictions(fits: dict[str, learn.Fitted], rows: DataFrame) -> DataFrame:
    """What the baselines, every variant and the combined form say for hidden stations, one row per station, period and model.

    rows: hidden station-days with FEATURES, actual, cell, fold and band.
    """
    scored = learn.predict_variants(fits, rows)
    near = F.coalesce(F.col("dist_nearest_km") <= THRESHOLD_KM, F.lit(False))
    both = scored.withColumn("combined", F.when(near, F.col(NEAR)).otherwise(F.col(FAR)))
    return per_period(both, {**BASELINES, **{n: n for n in [*fits, "combined"]}})
