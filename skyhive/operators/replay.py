"""Replaying stored replies: content keys, hits and misses, and the health of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(model, prompt_version, endpoint, *body) -> Column:
    """Digest of everything that decides a reply. Binary parts are passed as digests, not as content.

    The parts go into a JSON object, unknown ones as null, so no two requests read alike.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in (model, prompt_version, endpoint, *body)]
    named = F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def binary_digest(content) -> Column:
    """sha256 and length in place of the bytes."""
    data = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit("sha256:"), F.sha2(data, 256), F.lit(":"), F.length(data).cast("string"))


def replay(requests: DataFrame, store: DataFrame, offline: bool = True) -> DataFrame:
    """requests with the stored reply and `outcome`: hit, miss, or offline_miss when no call may be made."""
    absent = "offline_miss" if offline else "miss"
    known = store.select("key", "response").withColumn("_there", F.lit(True))
    return (requests.join(known, "key", "left")
            .withColumn("outcome", F.when(F.col("_there"), "hit").otherwise(absent)).drop("_there"))


def missing_keys(requests: DataFrame, store: DataFrame) -> DataFrame:
    """The distinct calls still to be made."""
    return requests.join(store.select("key"), "key", "left_anti").select("key").distinct()


def outcome_counts(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


def is_error(response: str = "response") -> Column:
    return F.coalesce(F.get_json_object(response, "$.error").isNotNull(), F.lit(False))


def is_usable(response: str = "response") -> Column:
    """The first candidate has at least one part."""
    parts = F.get_json_object(response, "$.candidates[0].content.parts[0]")
    return F.coalesce(parts.isNotNull(), F.lit(False))


def store_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("model", "prompt_version").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.length("response").cast("bigint")).alias("characters"),
        F.sum(is_error().cast("bigint")).alias("errors"), F.sum((~is_usable()).cast("bigint")).alias("unusable"))


def prune_errors(store: DataFrame) -> DataFrame:
    return store.where(~is_error())


def match_by_content(uploads: DataFrame, known: DataFrame, content: str) -> DataFrame:
    """Uploads recognised by the digest of their bytes. known: sha256, id."""
    return uploads.withColumn("sha256", F.sha2(F.col(content), 256)).join(
        known.select("sha256", F.col("id").alias("matched_id")), "sha256", "left")
