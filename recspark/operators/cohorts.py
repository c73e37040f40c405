"""Disjoint cohorts, stratified subsets and table fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from recspark.functions.ordering import numbered_by_draw
from recspark.functions.portable import draw

# fixed values: cohort names in the order they are filled
COHORTS = ("development", "confirmation_a", "confirmation_b")


def cohort_ledger(
    eligible: DataFrame, historical: DataFrame, excluded: DataFrame, sizes: dict[str, int], seed: int = 42
) -> DataFrame:
    """``user_id, cohort``: fill the cohorts in draw order from the unblocked pool; the rest is reserve.

    Raises when the pool is smaller than the sizes ask for.
    """
    pool = eligible.select("user_id").distinct()
    for blocked in (historical, excluded):
        pool = pool.join(blocked.select("user_id"), "user_id", "left_anti")
    pool = pool.withColumn("draw", draw(seed, F.col("user_id")))
    placed = numbered_by_draw(pool, "draw", "user_id")
    needed = sum(sizes[name] for name in COHORTS)
    available = pool.count()
    if available < needed:
        raise ValueError(f"pool too small: {available} users for {needed} places")
    label = F.lit("reserve")
    upper = needed
    for name in reversed(COHORTS):
        label = F.when(F.col("position") <= upper, F.lit(name)).otherwise(label)
        upper -= sizes[name]
    return placed.select("user_id", label.alias("cohort"))


def stratified_subset(cases: DataFrame, sizes: dict[str, int], stratum: str, order: str) -> DataFrame:
    """First ``n`` rows of each stratum by ``order``; raises when a stratum is short."""
    w = Window.partitionBy(stratum).orderBy(order)
    wanted = reduce(
        lambda acc, kv: F.when(F.col(stratum) == kv[0], F.lit(kv[1])).otherwise(acc), sizes.items(), F.lit(0)
    )
    limit = max(sizes.values())
    ranked = (
        cases.filter(F.col(stratum).isin(*sizes))
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= limit)
        .filter(F.col("__rn") <= wanted)
    )
    counts = {r[stratum]: r["n"] for r in ranked.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {s: n for s, n in sizes.items() if counts.get(s, 0) < n}
    if short:
        raise ValueError(f"not enough cases for requested stratified subset: {sorted(short)}")
    return ranked.drop("__rn")


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a table's rows, duplicates included.

    Every row hash is cut into words that are summed, so the digest is a plain
    partial aggregate: it never sorts or gathers rows.
    """
    # A struct as JSON quotes its values and keeps nulls, so no two rows share a text.
    fields = F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    words = df.select(F.sha2(text, 256).alias("h"))
    sums = [
        F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)
    ]
    total = words.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return total.select(
        "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("fingerprint")
    )
