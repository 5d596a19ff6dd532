"""Flat runs: the same value again and again without a gap, long enough to betray a stuck sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
PM_PARAMETERS = ["pm25", "pm10"]
PLACEHOLDERS = [985.0, 1985.0]
MAX_GAP_SECONDS = 61 * 60
STUCK_SPAN_SECONDS = 23 * 3600
USABLE = ["ok", "unchecked"]


def _seconds(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def with_runs(df: DataFrame, keys: list[str], ts: str, value: str, tie: list[str],
              gap_seconds: int = MAX_GAP_SECONDS, piece: str = "day", run: str | None = None) -> DataFrame:
    """Adds run_start and run_end, the first and last time of the run each row belongs to, and under the name
    `run` a value that numbers the runs of a series in their order.

    A series is cut into calendar pieces so that one busy sensor is spread over many tasks. Runs are found
    inside each piece; only the first and last run of a piece can go on in a neighbour, so the step that
    joins pieces sees at most two rows per piece. Rows of one piece never leave the task that sorted them.
    """
    gap = gap_seconds * 1_000_000
    rows = df.withColumn("_piece", F.date_trunc(piece, F.col(ts))).withColumn("_t", _seconds(ts))
    slot = [*keys, "_piece"]
    line = Window.partitionBy(*slot).orderBy("_t", *tie)
    before_t, before_v = F.lag("_t").over(line), F.lag(value).over(line)
    breaks = before_t.isNull() | (before_v != F.col(value)) | (F.col("_t") - before_t > gap)
    rows = rows.withColumn("_brk", breaks.cast("int")).withColumn("_run", F.sum("_brk").over(line))
    one_run, whole = Window.partitionBy(*slot, "_run"), Window.partitionBy(*slot)
    rows = (rows.withColumn("_s", F.min("_t").over(one_run)).withColumn("_e", F.max("_t").over(one_run))
            .withColumn("_runs", F.max("_run").over(whole)))

    first, last = F.col("_run") == 1, F.col("_run") == F.col("_runs")
    ends = rows.groupBy(*slot).agg(
        F.max("_runs").alias("_runs"),
        F.max(F.when(first, F.col(value))).alias("v1"), F.min(F.when(first, F.col("_s"))).alias("s1"),
        F.max(F.when(first, F.col("_e"))).alias("e1"),
        F.max(F.when(last, F.col(value))).alias("v2"), F.min(F.when(last, F.col("_s"))).alias("s2"),
        F.max(F.when(last, F.col("_e"))).alias("e2"))
    node = lambda pos, v, s, e: F.struct(F.lit(pos).alias("pos"), F.col(v).alias("v"),
                                         F.col(s).alias("s"), F.col(e).alias("e"))
    nodes = ends.select(*slot, F.explode(
        F.when(F.col("_runs") == 1, F.array(node(1, "v1", "s1", "e1")))
        .otherwise(F.array(node(1, "v1", "s1", "e1"), node(2, "v2", "s2", "e2")))).alias("_n"))
    chain = Window.partitionBy(*keys).orderBy("_piece", "_n.pos")
    goes_on = ((F.col("_n.pos") == 1) & (F.lag("_n.v").over(chain) == F.col("_n.v"))
               & (F.col("_n.s") - F.lag("_n.e").over(chain) <= gap))
    nodes = (nodes.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
             .withColumn("_island", F.sum("_new").over(chain)))
    island = Window.partitionBy(*keys, "_island")
    nodes = nodes.withColumn("_fs", F.min("_n.s").over(island)).withColumn("_fe", F.max("_n.e").over(island))
    found = ["_fs", "_fe"]
    if run:
        nodes = nodes.withColumn("_id", F.first(F.struct("_piece", F.col("_n.pos").alias("no"))).over(
            island.orderBy("_piece", "_n.pos")))
        found.append("_id")
    joined = nodes.groupBy(*slot).agg(*[
        F.max(F.when(F.col("_n.pos") == pos, F.col(src))).alias(f"{src}{pos}")
        for pos in (1, 2) for src in found])

    out = rows.join(joined, slot, "left")
    start = F.when(F.col("_run") == 1, F.col("_fs1")).when(
        F.col("_run") == F.col("_runs"), F.col("_fs2")).otherwise(F.col("_s"))
    end = F.when(F.col("_run") == 1, F.col("_fe1")).when(
        F.col("_run") == F.col("_runs"), F.col("_fe2")).otherwise(F.col("_e"))
    more = []
    if run:  # by piece, then first run, inner runs by number, last run
        inner = lambda pos, no: F.struct("_piece", F.lit(pos).alias("pos"), no.alias("no"))
        node_id = lambda c: F.struct(F.col(f"{c}._piece"), F.when(F.col(f"{c}.no") == 1, 0).otherwise(2).alias("pos"),
                                     F.lit(0).alias("no"))
        more.append(F.when(F.col("_run") == 1, node_id("_id1")).when(F.col("_run") == F.col("_runs"), node_id("_id2"))
                    .otherwise(inner(1, F.col("_run").cast("int"))).alias(run))
    return out.select(*df.columns, F.timestamp_micros(start).alias("run_start"),
                      F.timestamp_micros(end).alias("run_end"), *more)


def quality_flag(span_seconds: int = STUCK_SPAN_SECONDS) -> Column:
    span = _seconds("run_end") - _seconds("run_start")
    return (F.when(F.col("value").isin(PLACEHOLDERS), F.lit("stuck_placeholder"))
            .when(span >= span_seconds * 1_000_000, F.lit("stuck_run")).otherwise(F.lit("ok")))


def flag_quality(readings: DataFrame, tie: list[str], gap_seconds: int = MAX_GAP_SECONDS,
                 span_seconds: int = STUCK_SPAN_SECONDS) -> DataFrame:
    """Adds or refreshes quality_flag; no row is added or removed. Other parameters are 'unchecked'."""
    base = readings.drop("quality_flag")
    checked = with_runs(base.where(F.col("parameter").isin(PM_PARAMETERS)), ["station_id", "parameter"],
                        "timestamp_utc", "value", tie, gap_seconds)
    flagged = checked.withColumn("quality_flag", quality_flag(span_seconds)).drop("run_start", "run_end")
    other = (base.where(~F.coalesce(F.col("parameter").isin(PM_PARAMETERS), F.lit(False)))
             .withColumn("quality_flag", F.lit("unchecked")))
    return flagged.unionByName(other)


def usable(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("quality_flag").isin(USABLE))


def flag_counts(flagged: DataFrame, by: list[str]) -> DataFrame:
    """ok / placeholder / run counts of the PM channels with the flagged share in percent."""
    names = ["ok", "stuck_placeholder", "stuck_run"]
    wide = (flagged.where(F.col("parameter").isin(PM_PARAMETERS)).groupBy(*by)
            .agg(*[F.sum((F.col("quality_flag") == n).cast("bigint")).alias(n) for n in names]))
    bad = F.col("stuck_placeholder") + F.col("stuck_run")
    return wide.withColumn("flagged_pct", F.round(100 * bad / (F.col("ok") + bad), 6))


def most_flagged(flagged: DataFrame, n: int = 10) -> DataFrame:
    bad = F.col("quality_flag").isin("stuck_placeholder", "stuck_run").cast("bigint")
    return (flagged.where(F.col("parameter").isin(PM_PARAMETERS)).groupBy("state")
            .agg(F.sum(bad).alias("flagged_rows"))
            .orderBy(F.desc("flagged_rows"), "state").limit(n))
