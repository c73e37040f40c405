"""Ranking metrics, method aggregates and paired bootstrap comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recspark.functions.ordering import nearest_rank, numbered_by_id
from recspark.session import stored

#: Users whose values one task of a resampling holds, and draws made at once.
RESAMPLE_BLOCK, DRAWS = 1 << 22, 1 << 16
METRICS = ("recall_at_10", "ndcg_at_10", "mrr_at_10", "candidate_recall")


def gain(rank) -> F.Column:
    """Discounted gain of a 1-based rank."""
    return 1 / F.log2(F.lit(1.0) + rank)


def ideal_gain(n) -> F.Column:
    """Sum of the first ``n`` discounts."""
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + 1 / F.log2(F.lit(1.0) + i))


def topk_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, key: str = "user_id") -> DataFrame:
    """Recall, hit rate and NDCG at ``k`` for a set of relevant items per key."""
    labels = relevant.select(key, "item_id").distinct()
    hits = labels.join(
        ranked.filter(F.col("rank") <= k).select(key, "item_id", "rank"), [key, "item_id"], "left"
    )
    per_key = hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("relevant"),
        F.count("rank").alias("hits"),
        F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0)).alias("dcg"),
    )
    return per_key.select(
        key,
        (F.col("hits") / F.col("relevant")).alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"),
        (F.col("dcg") / ideal_gain(F.least(F.col("relevant"), F.lit(k)))).alias("ndcg"),
    )


def score_ranking(
    ranked: DataFrame, targets: DataFrame, hist: DataFrame, items: DataFrame, candidates: DataFrame | None = None,
    violations: DataFrame | None = None, k: int = 10,
) -> DataFrame:
    """Single-target metrics per user: recall, NDCG, MRR, candidate recall, constraint flag.

    ``targets(user_id, item_id)`` gives every evaluated user, also those without
    any ranked row. Constraints hold when no top row was seen before, is missing
    from the catalog, or appears in ``violations(user_id, item_id)``.
    """
    top = ranked.filter(F.col("rank") <= k).select("user_id", "item_id", "rank")
    seen = hist.select("user_id", "item_id").distinct().withColumn("seen", F.lit(True))
    known = items.select("item_id").withColumn("known", F.lit(True))
    checked = top.join(seen, ["user_id", "item_id"], "left").join(known, "item_id", "left")
    bad = F.col("seen").isNotNull() | F.col("known").isNull()
    if violations is not None:
        broken = violations.select("user_id", "item_id").distinct().withColumn("broken", F.lit(True))
        checked = checked.join(broken, ["user_id", "item_id"], "left")
        bad = bad | F.col("broken").isNotNull()
    goal = targets.select("user_id", F.col("item_id").alias("target"))
    rows = goal.join(checked.withColumn("bad", bad), "user_id", "left")
    per_user = rows.groupBy("user_id", "target").agg(
        F.max(F.when(F.col("item_id") == F.col("target"), F.col("rank"))).alias("target_rank"),
        F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad"),
    )
    if candidates is None:
        # Every catalog item the user hasn't seen competes; an item outside the catalog can't.
        gone = seen.select("user_id", F.col("item_id").alias("target"), F.col("seen").alias("gone"))
        listed = items.select(F.col("item_id").alias("target"), F.lit(True).alias("listed")).distinct()
        per_user = per_user.join(gone, ["user_id", "target"], "left").join(listed, "target", "left")
        recall = (F.col("gone").isNull() & F.col("listed").isNotNull()).cast("double")
    else:
        member = candidates.select("user_id", F.col("item_id").alias("target")).distinct().withColumn("m", F.lit(1.0))
        per_user = per_user.join(member, ["user_id", "target"], "left")
        recall = F.coalesce("m", F.lit(0.0))
    found = F.col("target_rank")
    return per_user.select(
        "user_id",
        "target_rank",
        found.isNotNull().cast("double").alias("recall_at_10"),
        F.coalesce(gain(found), F.lit(0.0)).alias("ndcg_at_10"),
        F.coalesce(1.0 / found, F.lit(0.0)).alias("mrr_at_10"),
        recall.alias("candidate_recall"),
        (~F.col("bad")).alias("constraint_satisfied"),
    )


def method_aggregates(metrics: DataFrame, ranked: DataFrame, universe: int, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Means, catalog coverage and nearest-rank latency quantiles per method."""
    means = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("users"),
        *[F.avg(m).alias(m) for m in METRICS],
        F.avg(F.col("constraint_satisfied").cast("double")).alias("constraint_rate"),
    )
    covered = (
        ranked.select(*by, "item_id").distinct().groupBy(*by).agg((F.count(F.lit(1)) / F.lit(universe)).alias("coverage"))
    )
    quantiles = nearest_rank(metrics, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}, by)
    return means.join(covered, list(by), "left").join(quantiles, list(by), "left").fillna(0.0, ["coverage"])


def paired_values(metrics: DataFrame, methods: list[str], value: str = "ndcg_at_10") -> DataFrame:
    """One row per user with the value of every method; every method must cover every user."""
    wide = metrics.groupBy("user_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col(value))).alias(m) for m in methods],
    )
    complete = reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(m) for m in methods])
    checked = F.when(complete, F.lit(True)).otherwise(
        F.raise_error(F.lit("paired bootstrap needs one finite value per user and method"))
    )
    return wide.filter(checked)


def bootstrap_deltas(
    wide: DataFrame, pairs: list[tuple[str, str]], seed: int = 42, resamples: int = 2000
) -> DataFrame:
    """Percentile interval of the mean paired difference, for all pairs in one job.

    Draw ``i`` of resample ``b`` takes user ``draw(seed, b, i) mod n``. All pairs
    share the draws.
    """
    if resamples <= 0:
        raise ValueError("resamples must be positive")
    deltas = [(F.col(b) - F.col(a)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    names = [f"d{i}" for i in range(len(pairs))]
    indexed = numbered_by_id(wide, "user_id", name="position").select(
        (F.col("position") - 1).alias("j"), *deltas
    )
    n = indexed.groupBy().agg(F.count(F.lit(1)).alias("n"))
    size = bounded_count(n)
    if size == 0:
        raise ValueError("paired bootstrap needs at least one user")
    sums = resample_sums(indexed, names, size, seed, resamples)
    means = sums.groupBy("b").agg(*[(F.sum(d) / F.lit(size)).alias(d) for d in names])
    bounds = means.agg(
        *[F.percentile(d, F.array(F.lit(0.025), F.lit(0.975))).alias(d) for d in names],
    )
    centre = indexed.agg(*[F.avg(d).alias(f"m{i}") for i, d in enumerate(names)], F.count(F.lit(1)).alias("users"))
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left_method"),
                F.lit(b).alias("right_method"),
                F.col(f"m{i}").alias("mean_delta"),
                F.element_at(f"d{i}", 1).alias("lower"),
                F.element_at(f"d{i}", 2).alias("upper"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    one = F.lit(1).alias("one")
    joined = bounds.select("*", one).join(centre.select("*", one), "one")
    return joined.select(F.explode(rows).alias("r"), "users").select("r.*", "users")


def resample_sums(indexed: DataFrame, names: list[str], size: int, seed: int, resamples: int, block: int = RESAMPLE_BLOCK) -> DataFrame:
    """``(b, *names)``: per resample and block of users the sums of the drawn rows.

    ``indexed(j, *names)`` numbers the users from 0. Their values are packed into blocks;
    a task holds one block and makes the draws of some resamples, of which it adds up
    those that fall into its block. So neither draws nor users are shuffled, whatever
    their number; draws are made once per block of ``block`` users."""
    number = F.floor(F.col("j") / block).cast("int")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("j")
        values = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        return pa.table({"lo": rows.column("j").slice(0, 1), "block": pa.array([values.tobytes()], pa.binary())})

    packed = stored(indexed.withColumn("ub", number).groupBy("ub").applyInArrow(build, "lo bigint, block binary"), "deltas")
    cores = indexed.sparkSession.sparkContext.defaultParallelism
    parts = min(resamples, max(1, math.ceil(4 * cores * block / max(size, block))))
    cells = packed.select("lo", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "lo", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, blob, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(blob).reshape(-1, len(names))
                own = range(1 + part, resamples + 1, parts)
                total = np.zeros((len(own), len(names)))
                for first in range(0, size, DRAWS):
                    keys = [b"%d" % i for i in range(first, min(first + DRAWS, size))]
                    for n, b in enumerate(own):
                        head = b"%d|%d|" % (seed, b)
                        heads = b"".join([md5(head + k).digest()[:4] for k in keys])
                        at = np.frombuffer(heads, ">u4").astype(np.int64) % size - lo
                        total[n] += values[at[(at >= 0) & (at < len(values))]].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(c) for c in total.T)], ["b", *names])

    return cells.mapInArrow(run, "b int, " + ", ".join(f"{c} double" for c in names))


def bounded_count(counted: DataFrame) -> int:
    return int(counted.first()[0])


def paired_bootstrap(
    metrics: DataFrame, baseline: str, candidate: str, seed: int = 42, resamples: int = 2000,
    value: str = "ndcg_at_10",
) -> DataFrame:
    wide = paired_values(metrics, [baseline, candidate], value)
    return bootstrap_deltas(wide, [(baseline, candidate)], seed, resamples)


def pairwise_summary(
    metrics: DataFrame, methods: list[str], seed: int = 42, resamples: int = 2000, value: str = "ndcg_at_10"
) -> DataFrame:
    """Every ordered pair of methods (left < right) with one shared set of draws."""
    names = sorted(methods)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return bootstrap_deltas(paired_values(metrics, names, value), pairs, seed, resamples)
