"""Building blocks that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 4096
BUCKET_SHIFT = 8_000_000  # larger than 4096 * log2(any double), keeps positive and negative apart


def same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def latest(df: DataFrame, keys: list[str], order: list, keep: list[str] | None = None,
           last: bool = True) -> DataFrame:
    """One row per key, the last (or first) by order, with the number of rows it stands for in `copies`.

    An aggregate rather than a row number: it combines before the shuffle, so a key with a third of all
    rows sends one row per task.
    """
    keep = keep or [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in keep])
    grouped = df.groupBy(*keys).agg(pick(row, rank).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep], "copies")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi-join whose big side may pile up on few keys; `spread` must be a deterministic function of a row."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("salting repeats the right side, so only inner, left and left_semi joins stay exact")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def digest_rank(df: DataFrame, *key, seed: str = "") -> DataFrame:
    """Adds `pos`, the place 0, 1, 2, ... of each row in the order of a digest of its key.

    Equal to numbering all rows in one sorted list, but done in 4096 shares: places inside a share, plus
    the sizes of the shares before it.
    """
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key])
    rows = df.withColumn("_md", F.md5(text)).withColumn("_share", F.substring("_md", 1, 3))
    sizes = rows.groupBy("_share").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_share")) - F.col("_size"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_share").orderBy("_md", *key)))
    return (inside.join(F.broadcast(before), "_share")  # at most 4096 rows
            .withColumn("pos", (F.col("_before") + F.col("_at") - 1).cast("bigint"))
            .select(*df.columns, "pos"))


def value_bucket(value: Column) -> Column:
    """A coarse order-preserving bucket, 4096 to each doubling of magnitude."""
    size = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_DOUBLING) + F.lit(BUCKET_SHIFT)
    return F.when(value == 0, F.lit(0)).otherwise(size * F.signum(value).cast("bigint")).cast("bigint")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per name, plus the count `n`.

    Two passes of counting, each combined before its shuffle: first coarse buckets, then only the values
    inside the buckets that hold a wanted position. No group is ever gathered or sorted whole.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", value_bucket(F.col("_v")))
    coarse = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_key = Window.partitionBy(*keys)
    placed = (coarse
              .withColumn("n", F.sum("_c").over(by_key))
              .withColumn("_before", F.sum("_c").over(by_key.orderBy("_b")) - F.col("_c")))
    def wanted(n: Column) -> Column:
        """Two neighbouring positions per quantile; the value lies between them."""
        slots = []
        for name, p in probs.items():
            at = F.lit(float(p)) * (n - 1)
            for pos in (F.floor(at), F.ceil(at)):
                slots.append(F.struct(F.lit(name).alias("name"), at.alias("at"), pos.alias("pos")))
        return F.array(*slots)

    def holds(first: Column, size: Column):
        return lambda w: (w["pos"] >= first) & (w["pos"] < first + size)

    hits = placed.where(F.exists(wanted(F.col("n")), holds(F.col("_before"), F.col("_c"))))
    match = reduce(lambda a, b: a & b,
                   [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], F.col("r._b") == F.col("s._b"))
    inside = (rows.alias("r").join(hits.select(*keys, "_b", "n", "_before").alias("s"), match)
              .select("r.*", "s.n", "s._before")
              .groupBy(*keys, "_b", "_v", "n", "_before").agg(F.count(F.lit(1)).alias("_c")))
    step = Window.partitionBy(*keys, "_b").orderBy("_v")
    found = (inside.withColumn("_from", F.col("_before") + F.sum("_c").over(step) - F.col("_c"))
             .withColumn("_w", F.explode(F.filter(wanted(F.col("n")), holds(F.col("_from"), F.col("_c"))))))

    def at_position(name: str, side) -> Column:
        return F.max(F.when((F.col("_w.name") == name) & (F.col("_w.pos") == side("_w.at")), F.col("_v")))

    out = []
    for name in probs:
        low, high = at_position(name, F.floor), at_position(name, F.ceil)
        part = F.max(F.when(F.col("_w.name") == name, F.col("_w.at") - F.floor("_w.at")))
        out.append((low + (high - low) * part).alias(name))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *out)
