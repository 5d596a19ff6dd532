"""Boosted trees on station-days: folds by cell, level or residual targets, fold-aware and mean prediction.

A fold's model is a Spark ML pipeline of fills and markers for missing numbers, the feature vector, and trees, so that
what is saved is all that new rows need. Boosting ends when a round's gain does, measured on cells held out inside the
training folds; folds are fitted side by side, since a round is a chain of small jobs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.operators.features import FEATURES, feature_group
from skyhive.operators.scale import digest_rank
from skyhive.session import cut_lineage, shared_root

# Boosting settings
STEP = 0.05
MIN_LEAF_ROWS = 40
ROW_SHARE = 0.85
COLUMN_SHARE = "0.85"
MOST_ROUNDS = 600
DEPTH = 6  # 64 leaves
# Our own: a round that gains less than this share of the error on held-out cells is the last; every n-th training
# cell is held out for that; rounds between checkpoints of the chain of predictions
GAIN_END = 1e-3
HELD_EVERY = 10
CHECKPOINT_ROUNDS = 10
# The three compared variants
VARIANTS = {
    "m1_level_l1": {"target": "level", "loss": "absolute", "drop": []},
    "m2_residual_l2": {"target": "residual", "loss": "squared", "drop": []},
    "m3_residual_l2_nogeo": {"target": "residual", "loss": "squared", "drop": ["lat", "lon"]},
}
OFTEN_MISSING = ["no2_trop", "aai", "co", "so2", "wind_speed", "upwind_fires_150km"]


def assign_folds(cells: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """A fold per cell, so that stations sharing a cell never straddle a split. Fold sizes differ by at most one."""
    ranked = digest_rank(cells.select("cell").distinct(), "cell", seed=str(seed))
    return ranked.select("cell", (F.col("pos") % folds).cast("int").alias("fold"))


def training_rows(hidden: DataFrame, cell_days: DataFrame) -> DataFrame:
    """Station-days with neighbour features that never saw the station, plus the cell's own features."""
    days = cell_days.withColumnRenamed("date", "period")
    return hidden.join(days, ["cell", "period"], "left")


@dataclass
class Fitted:
    """Fold models with what is needed to score new rows, and the held-out error after each round of each fold."""

    models: dict[int, PipelineModel]
    features: list[str]
    target: str
    errors: dict[int, list[float]] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [*self.features, *[f"no_{c}" for c in OFTEN_MISSING if c in self.features]]


def feature_list(drop: list[str] | None = None) -> list[str]:
    unknown = set(drop or []) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features to drop: {sorted(unknown)}")
    return [f for f in FEATURES if f not in (drop or [])]


def _medians(rows: DataFrame, features: list[str]) -> dict[str, float]:
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5, 10000).alias(f) for f in features]).first()
    return {f: float(row[f]) if row[f] is not None else 0.0 for f in features}


def _prepared(features: list[str], fills: dict[str, float]) -> list:
    """Stages before the trees: missing numbers take the training median, and a marker says that they were missing."""
    marked = [c for c in OFTEN_MISSING if c in features]
    known = lambda f: f"nanvl(CAST({f} AS DOUBLE), NULL)"
    columns = [f"coalesce({known(f)}, {fills[f]!r}D) AS x_{f}" for f in features] + [f"CAST({known(f)} IS NULL AS DOUBLE) AS no_{f}" for f in marked]
    names = [f"x_{f}" for f in features] + [f"no_{f}" for f in marked]
    return [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"), VectorAssembler(inputCols=names, outputCol="vector")]


def held_cells(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Every tenth cell in a digest's order, whole cells, so that no station judges itself; one at least."""
    ranked = digest_rank(rows.select("cell").distinct(), "cell", seed=f"held-{seed}")
    return ranked.where(F.col("pos") % HELD_EVERY == 0).select("cell")


def fit_folds(rows: DataFrame, folds: int, target: str = "level", loss: str = "squared", drop: list[str] | None = None,
              rounds: int = MOST_ROUNDS, depth: int = DEPTH, seed: int = 0, side_by_side: int = 4) -> Fitted:
    """One model per fold, trained on all other folds. rows: FEATURES, actual, cell, fold."""
    features = feature_list(drop)
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_root(rows.sparkSession)}/boosting")
    label = F.col("actual") - F.col("neighbour_idw") if target == "residual" else F.col("actual")
    known = rows.withColumn("label", label).where("label IS NOT NULL")

    def fit(fold: int):
        seen = known.where(F.col("fold") != fold)
        held = held_cells(seen, seed).withColumn("held", F.lit(True))
        stages = _prepared(features, _medians(seen, features))
        ready = seen.join(held, "cell", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        for stage in stages:
            ready = stage.transform(ready)
        ready = cut_lineage(ready.select("vector", "label", "held"), "boosting-rows")
        booster = GBTRegressor(featuresCol="vector", labelCol="label", predictionCol="fold_estimate", lossType=loss, maxIter=rounds, maxDepth=depth,
                               stepSize=STEP, minInstancesPerNode=MIN_LEAF_ROWS, subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE,
                               seed=seed, maxMemoryInMB=512, checkpointInterval=CHECKPOINT_ROUNDS, validationIndicatorCol="held", validationTol=GAIN_END)
        trees = booster.fit(ready)
        return PipelineModel([*stages, trees]), list(trees.evaluateEachIteration(ready.where("held"), loss))

    with ThreadPoolExecutor(min(side_by_side, folds)) as pool:
        found = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds)))
    return Fitted({k: m for k, (m, _) in enumerate(found)}, features, target, {k: e for k, (_, e) in enumerate(found)})


def _anchor(value, target: str):
    return F.col("neighbour_idw") + value if target == "residual" else value


def _scored(fitted: Fitted, fold: int, rows: DataFrame, name: str) -> DataFrame:
    made = ["vector", *[f"x_{f}" for f in fitted.features], *[i for i in fitted.inputs if i.startswith("no_") and i not in fitted.features]]
    return fitted.models[fold].transform(rows).drop(*made).withColumnRenamed("fold_estimate", name)


def predict_hidden(fitted: Fitted, rows: DataFrame, name: str) -> DataFrame:
    """Each row scored by the model that never trained on its cell; cells without a fold use fold 0."""
    return predict_variants({name: fitted}, rows)


def predict_variants(fits: dict[str, Fitted], rows: DataFrame) -> DataFrame:
    """The same for several sets over one split into folds, a column each. The rows are split by fold once for all sets, so
    that they are read as often as there are folds, not once for every choice of a fold in each set."""
    splits = {tuple(sorted(fitted.models)) for fitted in fits.values()}
    if len(splits) != 1:
        raise ValueError(f"sets over different folds: {sorted(splits)}")
    placed = rows.withColumn("fold", F.coalesce("fold", F.lit(0)))
    parts = []
    for fold in splits.pop():
        scored = placed.where(F.col("fold") == fold)
        for name, fitted in fits.items():
            scored = _scored(fitted, fold, scored, "_raw").withColumn(name, _anchor(F.col("_raw"), fitted.target)).drop("_raw")
        parts.append(scored)
    return reduce(DataFrame.unionByName, parts)


def predict_mean(fitted: Fitted, rows: DataFrame, name: str) -> DataFrame:
    """Mean of all fold models, scored in one pass over the rows."""
    out, columns = rows, []
    for fold in fitted.models:
        columns.append(f"_fold{fold}")
        out = _scored(fitted, fold, out, columns[-1])
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    return out.withColumn(name, _anchor(mean, fitted.target)).drop(*columns)


def error_by_round(fitted: Fitted, variant: str, spark: SparkSession) -> DataFrame:
    """variant, fold, round, error on held-out cells (a few hundred rows a fold)."""
    rows = [(variant, fold, i + 1, float(e)) for fold, errors in fitted.errors.items() for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "variant string, fold int, round int, error double")


def importance(fitted: Fitted, variant: str, spark: SparkSession) -> DataFrame:
    """Gain of each feature in percent, averaged over the fold models (a few dozen rows)."""
    names = fitted.inputs
    rows = [(variant, fold, name.removeprefix("no_"), float(gain))
            for fold, model in fitted.models.items()
            for name, gain in zip(names, model.stages[-1].featureImportances.toArray())]
    raw = spark.createDataFrame(rows, "variant string, fold int, feature string, gain double")
    return summarise_importance(raw)


def summarise_importance(raw: DataFrame) -> DataFrame:
    """raw: variant, fold, feature, gain -> variant, feature, feature_group, gain_pct."""
    per_fold = raw.groupBy("variant", "fold", "feature").agg(F.sum("gain").alias("gain"))
    mean = per_fold.groupBy("variant", "feature").agg(F.avg("gain").alias("gain"))
    total = mean.groupBy("variant").agg(F.sum("gain").alias("total"))
    return mean.join(total, "variant").select(
        "variant", "feature", feature_group("feature").alias("feature_group"),
        (100 * F.try_divide("gain", "total")).alias("gain_pct"))


def importance_by_group(summary: DataFrame) -> DataFrame:
    return summary.groupBy("variant", "feature_group").agg(F.sum("gain_pct").alias("gain_pct"))


def importance_pivot(summary: DataFrame, variants: list[str]) -> DataFrame:
    return summary.groupBy("feature", "feature_group").pivot("variant", variants).agg(F.max("gain_pct"))


def top_features(summary: DataFrame, n: int = 3) -> DataFrame:
    from pyspark.sql import Window
    order = Window.partitionBy("variant").orderBy(F.desc("gain_pct"), "feature")
    return summary.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def save(fitted: Fitted, path: str) -> None:
    """Fold pipelines beside each other; settings as one small JSON row."""
    import json

    spark = SparkSession.getActiveSession()
    for fold, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/fold={fold}")
    about = {"features": fitted.features, "target": fitted.target, "errors": fitted.errors, "folds": sorted(fitted.models)}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def restore(path: str) -> Fitted:
    import json

    spark = SparkSession.getActiveSession()
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    models = {fold: PipelineModel.load(f"{path}/fold={fold}") for fold in about["folds"]}
    return Fitted(models, about["features"], about["target"], {int(fold): e for fold, e in about["errors"].items()})
