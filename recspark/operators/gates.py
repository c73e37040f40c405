"""Promotion gate, replay of stored evidence, seed robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from recspark.operators.metrics import METRICS, bootstrap_deltas, paired_values

POSTHOC_SEEDS = (42, 7, 2026)  # fixed values


def promotion_gate(metrics: DataFrame, baseline: str, candidate: str, seed: int = 42, resamples: int = 2000) -> DataFrame:
    """One row: better mean, interval above zero, constraints always met, and whether all hold.

    Means are recomputed from the per-user rows.
    """
    delta = bootstrap_deltas(paired_values(metrics, [baseline, candidate]), [(baseline, candidate)], seed, resamples)
    base, cand = F.col("method") == baseline, F.col("method") == candidate
    means = metrics.agg(
        F.avg(F.when(base, F.col("ndcg_at_10"))).alias("baseline_ndcg"),
        F.avg(F.when(cand, F.col("ndcg_at_10"))).alias("candidate_ndcg"),
        F.avg(F.when(cand, F.col("constraint_satisfied").cast("double"))).alias("constraint_rate"),
        F.lit(1).alias("one"),
    )
    row = delta.withColumn("one", F.lit(1)).join(means, "one")
    better = F.col("candidate_ndcg") > F.col("baseline_ndcg")
    above = F.col("lower") > 0
    clean = F.col("constraint_rate") == 1
    reason = (
        F.when(~better, "mean NDCG@10 did not improve")
        .when(~above, "confidence interval crosses zero")
        .when(~clean, "constraints were not satisfied for every user")
        .otherwise("")
    )
    return row.select(
        "baseline_ndcg", "candidate_ndcg", "mean_delta", "lower", "upper", "constraint_rate", better.alias("mean_improved"),
        above.alias("interval_above_zero"), clean.alias("constraints_met"), (better & above & clean).alias("passed"), reason.alias("reason"),
    )


def summary_rows(metrics: DataFrame, methods: Sequence[str], seed: int = 42, resamples: int = 2000) -> DataFrame:
    """Method means and pairwise intervals as a long table ``(entry, field, value)``."""
    fields = [*METRICS, "constraint_rate"]
    means = metrics.groupBy("method").agg(
        *[F.avg(m).alias(m) for m in METRICS], F.avg(F.col("constraint_satisfied").cast("double")).alias("constraint_rate")
    )
    long = lambda df, name, cols: df.select(
        name.alias("entry"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in cols])).alias("c")
    ).select("entry", "c.field", "c.value")
    names = sorted(methods)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    boot = bootstrap_deltas(paired_values(metrics, names), pairs, seed, resamples)
    pair = F.concat_ws("_vs_", "right_method", "left_method")
    return long(means, F.col("method"), fields).unionByName(long(boot, pair, ["mean_delta", "lower", "upper"]))


def replay_check(metrics: DataFrame, stored: DataFrame, methods: Sequence[str], seed: int = 42, resamples: int = 2000, tol: float = 1e-9) -> DataFrame:
    """Recompute a stored summary from its per-user rows; rows that differ, miss or are new come back."""
    fresh = summary_rows(metrics, methods, seed, resamples)
    both = fresh.withColumnRenamed("value", "replayed").join(
        stored.select("entry", "field", F.col("value").alias("recorded")), ["entry", "field"], "full_outer"
    )
    same = F.coalesce(F.abs(F.col("replayed") - F.col("recorded")) <= tol, F.lit(False))
    return both.filter(~same).select("entry", "field", "replayed", "recorded")


def seed_robustness(metrics: DataFrame, fields: Sequence[str], seeds: Sequence[int] = POSTHOC_SEEDS) -> DataFrame:
    """Per method and metric: mean, sample deviation, worst seed, worst value.

    ``metrics(method, seed, fields...)`` must hold exactly the given seeds once
    each; of equal worst values the first seed in the given order wins.
    """
    order = F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(seeds) for v in (s, i)]), F.col("seed"))
    cells = F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("value")) for f in fields])
    long = metrics.select("method", "seed", order.alias("ord"), F.explode(cells).alias("c")).select("method", "seed", "ord", "c.*")
    stats = long.groupBy("method", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sample_std"),
        F.min_by("seed", F.struct("value", "ord")).alias("worst_seed"),
        F.min("value").alias("worst_value"),
        (F.array_sort(F.collect_set("seed")) == F.array(*[F.lit(s) for s in sorted(seeds)])).alias("exact"),
        F.count(F.lit(1)).alias("n"),
    )
    ok = F.col("exact") & (F.col("n") == len(seeds))
    return stats.filter(
        F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("robustness requires exactly the given seeds")))
    ).drop("exact", "n")
