"""Popularity counts and per-user popularity ranking without users x items pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recspark.functions.ordering import numbered, quantile_bucket, top_k
from recspark.operators.splits import POSITIVE_THRESHOLD, positives


def popularity(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD) -> DataFrame:
    """Positive row count per item; duplicates count."""
    return positives(inter, threshold).groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))


def catalog_order(items: DataFrame, pop: DataFrame, partition: tuple[str, ...] = ()) -> DataFrame:
    """Number the catalog by (popularity DESC, item ASC); items without positives count 0.

    With ``partition`` (for instance a constraint profile) every group of items
    is numbered on its own.
    """
    ids = items.select(*partition, "item_id")
    counted = ids.join(pop, "item_id", "left").select(
        *partition, "item_id", F.coalesce(F.col("popularity"), F.lit(0)).cast("bigint").alias("popularity")
    )
    coarse = quantile_bucket(counted, "item_id", 64, "__ib", source=items)
    order = [F.col("popularity").desc(), F.col("item_id").asc()]
    return numbered(coarse, order, [("popularity", True), ("__ib", False)], partition).drop("__ib")


def first_unseen(users: DataFrame, order: DataFrame, hist: DataFrame, k: int, key: tuple[str, ...] = ()) -> DataFrame:
    """First ``k`` items of a catalog order that each user has not seen.

    A user with ``h`` seen items finds them among the first ``k + h`` positions:
    expand those positions, look the items up, and drop the seen ones. The work
    is linear in users * k plus history rows.
    """
    seen = hist.select("user_id", "item_id").distinct()
    sizes = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    positions = (
        users.select("user_id", *key)
        .join(sizes, "user_id", "left")
        .withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce(F.col("h"), F.lit(0)) + k)))
        .drop("h")
    )
    unseen = positions.join(order, [*key, "position"]).join(seen, ["user_id", "item_id"], "left_anti")
    ranked = unseen.withColumn("score", F.col("popularity").cast("double"))
    return top_k(ranked.select("user_id", "item_id", "score"), k)


def popularity_topk(
    inter: DataFrame, items: DataFrame, users: DataFrame, hist: DataFrame, k: int = 10,
    threshold: int = POSITIVE_THRESHOLD,
) -> DataFrame:
    """Most popular unseen catalog items per user, zero-count items included."""
    return first_unseen(users, catalog_order(items, popularity(inter, threshold)), hist, k)
