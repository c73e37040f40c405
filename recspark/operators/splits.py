"""Leakage-safe chronological splits, histories and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recspark.functions.ordering import numbered_by_id

POSITIVE_THRESHOLD = 4


def positives(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD) -> DataFrame:
    return inter.filter(F.col("rating") >= threshold)


def chronological_split(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(train, targets)``: the last two positive rows are validation and test.

    Users with fewer than three positive rows stay whole in train. Three rows
    per user survive the group limit, so the split needs no full per-user sort.
    """
    key = F.struct("ts", "item_id", "row_key")
    last = Window.partitionBy("user_id").orderBy(F.col("key").desc())
    ranked = (
        positives(inter, threshold)
        .select("user_id", "item_id", key.alias("key"))
        .withColumn("n", F.row_number().over(last))
        .filter(F.col("n") <= 3)
    )
    held = (
        ranked.groupBy("user_id")
        .agg(
            F.max(F.when(F.col("n") == 2, F.col("item_id"))).alias("validation_item"),
            F.max(F.when(F.col("n") == 1, F.col("item_id"))).alias("test_item"),
            F.max(F.when(F.col("n") == 2, F.col("key"))).alias("first_held"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") == 3)
    )
    held_out = (F.col("rating") >= threshold) & (key >= F.col("first_held"))
    train = (
        inter.join(held.select("user_id", "first_held"), "user_id", "left")
        .filter(F.col("first_held").isNull() | ~held_out)
        .select(*inter.columns)
    )
    return train, held.select("user_id", "validation_item", "test_item")


def ranking_targets(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD) -> DataFrame:
    """Last three distinct positive items per user, each at its latest row."""
    latest = (
        positives(inter, threshold)
        .groupBy("user_id", "item_id")
        .agg(F.max(F.struct("ts", "item_id", "rating")).alias("key"))
    )
    w = Window.partitionBy("user_id").orderBy(F.col("key").desc())
    last3 = latest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 3)

    def at(n: int, column: str):
        return F.max(F.when(F.col("n") == n, F.col(column)))

    return (
        last3.groupBy("user_id")
        .agg(
            at(3, "item_id").alias("ranker_item"),
            at(2, "item_id").alias("validation_item"),
            at(1, "item_id").alias("test_item"),
            at(3, "key").alias("ranker_key"),
            at(2, "key").alias("validation_key"),
        )
        .filter(F.col("ranker_item").isNotNull())
    )


def _before(inter: DataFrame, targets: DataFrame, bound: str, hidden: list[str]) -> DataFrame:
    """Rows strictly before ``bound`` whose item is not hidden; users without targets pass through."""
    point = F.struct("ts", "item_id", "rating")
    clean = point < F.col(bound)
    for column in hidden:
        clean = clean & (F.col("item_id") != F.col(column))
    return (
        inter.join(targets.select("user_id", bound, *hidden), "user_id", "left")
        .filter(F.col(bound).isNull() | clean)
        .select(*inter.columns)
    )


def ranker_history(inter: DataFrame, targets: DataFrame) -> DataFrame:
    return _before(inter, targets, "ranker_key", ["ranker_item", "validation_item", "test_item"])


def legal_train(inter: DataFrame, targets: DataFrame) -> DataFrame:
    return _before(inter, targets, "validation_key", ["validation_item", "test_item"])


def leakage_safe_split(
    inter: DataFrame, threshold: int = POSITIVE_THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(targets, history, legal_train)``.

    ``history`` is strictly before the ranker row and knows none of the three
    targets; ``legal_train`` is strictly before the validation row and may hold
    the ranker target.
    """
    targets = ranking_targets(inter, threshold)
    return (
        targets.select("user_id", "ranker_item", "validation_item", "test_item"),
        ranker_history(inter, targets),
        legal_train(inter, targets),
    )


def positive_histories(inter: DataFrame, items: DataFrame, threshold: int = POSITIVE_THRESHOLD) -> DataFrame:
    """Positive rows on catalog items."""
    return positives(inter, threshold).join(items.select("item_id"), "item_id", "left_semi").select(*inter.columns)


def restrict_users(inter: DataFrame, users: DataFrame) -> DataFrame:
    return inter.join(users.select("user_id"), "user_id", "left_semi")


def first_users(inter: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest user ids (the size of a training cohort is an argument)."""
    return inter.select("user_id").distinct().orderBy("user_id").limit(n)


def group_kfold(users: DataFrame, k: int = 3) -> DataFrame:
    """Whole-user folds: round robin over users in descending id order."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ids = users.select("user_id").distinct()
    return numbered_by_id(ids, "user_id", descending=True).select(
        "user_id", F.pmod(F.col("position") - 1, F.lit(k)).cast("int").alias("fold")
    )
