"""Writing tables: only the partitions that change, idempotent flags, monthly feature files, text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.operators.clean import refilter
from skyhive.operators.runs import flag_quality
from skyhive.session import cut_lineage

HISTORY_PARTITIONS = ["state", "parameter", "month"]


def replace_partitions(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Overwrites exactly the partitions present in df and leaves all others alone.

    Rows are clustered by partition plus a spread of 16, so a partition with a third of all rows is written
    by several tasks while a small one does not scatter into hundreds of files.
    """
    partitions = partitions or HISTORY_PARTITIONS
    others = [c for c in df.columns if c not in partitions]
    spread = F.pmod(F.xxhash64(*others), F.lit(16))
    (df.repartition(*[F.col(p) for p in partitions], spread)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
       .partitionBy(*partitions).parquet(path))


def refilter_history(spark: SparkSession, path: str, parameters: list[str] | None = None) -> DataFrame:
    """Re-applies the value rules in place; rewrites only partitions that lose rows. Returns drop counts."""
    table = spark.read.parquet(path)
    if parameters:
        table = table.where(F.col("parameter").isin(parameters))
    judged = refilter(table)
    counts = cut_lineage(judged.groupBy(*HISTORY_PARTITIONS, F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"))
                     .agg(F.count(F.lit(1)).alias("rows")), "refilter-counts")
    touched = counts.where("drop_reason <> 'kept'").select(*HISTORY_PARTITIONS).distinct()
    kept = (judged.where("drop_reason IS NULL").drop("drop_reason")
            .join(touched, HISTORY_PARTITIONS, "left_semi").select(*table.columns))
    staged = cut_lineage(kept, "refilter-rows")
    replace_partitions(staged, path)
    emptied = touched.join(counts.where("drop_reason = 'kept'"), HISTORY_PARTITIONS, "left_anti")
    for row in emptied.toLocalIterator():  # partitions without a single surviving row: names only
        _remove_partition(spark, path, row.asDict())
    return counts


def _remove_partition(spark: SparkSession, path: str, values: dict) -> None:
    jvm = spark._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = "/".join(f"{names.escapePathName(k)}={names.escapePathName(str(v))}" for k, v in values.items())
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def refresh_flags(spark: SparkSession, path: str, tie: list[str], **rule) -> DataFrame:
    """Adds or refreshes quality_flag in place; the number of rows must not change. Returns flag counts."""
    table = spark.read.parquet(path)
    before = table.count()
    flagged = cut_lineage(flag_quality(table, tie, **rule), "flags")
    after = flagged.count()
    if before != after:
        raise RuntimeError(f"flagging changed the number of rows from {before} to {after}")
    replace_partitions(flagged, path)
    return flagged.groupBy("parameter", "quality_flag").agg(F.count(F.lit(1)).alias("rows"))


def write_cell_days(df: DataFrame, path: str) -> None:
    """Feature table by month; floats on disk, doubles in computation."""
    slim = df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    replace_partitions(slim.withColumn("month", F.date_format("date", "yyyy-MM")), path, ["month"])


def write_documents(df: DataFrame, path: str) -> None:
    """Nested documents, one JSON row each, by date."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("ignoreNullFields", "false").partitionBy("date").json(path))


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _shown(name: str, kind: str, digits: int) -> Column:
    if kind in ("double", "float"):
        text = F.format_number(F.round(name, digits), digits)
    elif kind in ("bigint", "int"):
        text = F.format_number(name, 0)
    else:
        text = F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def markdown_rows(df: DataFrame, digits: int = 1) -> DataFrame:
    """Body lines of a Markdown table, one per row."""
    cells = [_shown(c, t, digits) for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def interval_text(value: str, low: str, high: str, percent: bool = False) -> Column:
    pattern = "%+.1f%% [%+.1f, %+.1f]" if percent else "%.1f [%.1f, %.1f]"
    return F.when(F.col(value).isNull(), F.lit("")).otherwise(F.format_string(pattern, value, low, high))


def bands_markdown(bands: DataFrame) -> DataFrame:
    """The published comparison, one Markdown line per model and band."""
    cells = [F.col("model"), F.col("band"), F.format_number("stations", 0), F.format_number("station_days", 0),
             interval_text("mae", "mae_lo", "mae_hi"), F.format_string("%.1f%%", "nmae_pct"),
             interval_text("vs_idw_pct", "vs_idw_lo", "vs_idw_hi", True),
             interval_text("vs_nearest_pct", "vs_nearest_lo", "vs_nearest_hi", True)]
    return bands.select("band", "model", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def run_summary(counts: DataFrame, corpus: DataFrame, profile: DataFrame) -> DataFrame:
    """The run summary as one JSON document. Inputs are small aggregates: drop counts, corpus counts, profile."""
    by = lambda keys: counts.where("drop_reason <> 'kept'").groupBy(*keys).agg(F.sum("rows").alias("rows"))
    table = lambda df, key, value: df.agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(key), F.col(value)))).alias("m")).scalar()
    nested = lambda outer, inner: by([outer, inner]).groupBy(outer).agg(F.map_from_entries(
        F.collect_list(F.struct(inner, "rows"))).alias("rows"))
    total = lambda test: F.sum(F.when(test, F.col("rows")).otherwise(0)).cast("bigint")
    kept = F.col("drop_reason") == "kept"
    item = lambda measure: corpus.where(F.col("measure") == measure)
    totals = counts.agg(F.sum("rows").cast("bigint").alias("raw_rows"), total(kept).alias("kept_rows"),
                        total(~kept).alias("dropped_rows"))
    units = profile.agg(F.array_sort(F.collect_list(F.struct(*profile.columns))).alias("u")).scalar()
    body = F.struct(
        "raw_rows", "kept_rows", "dropped_rows",
        table(by(["drop_reason"]), "drop_reason", "rows").alias("dropped_by_reason"),
        table(nested("parameter", "drop_reason"), "parameter", "rows").alias("dropped_by_parameter"),
        table(nested("drop_reason", "state"), "drop_reason", "rows").alias("dropped_by_state"),
        table(item("rows_per_parameter"), "item", "n").alias("rows_per_parameter"),
        table(item("stations_per_state"), "item", "n").alias("stations_per_state"),
        item("stations").agg(F.max("n").alias("n")).scalar().alias("stations"),
        item("states_covered").agg(F.max("n").alias("n")).scalar().alias("states_covered"),
        item("stations_without_district").agg(F.max("n").alias("n")).scalar().alias("stations_without_district"),
        units.alias("units"))
    return totals.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("summary"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
