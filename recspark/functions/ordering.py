"""Top-k, dense global numbering and exact order statistics without one-task sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from recspark.functions.portable import order_score

NEG_INF, POS_INF = float("-inf"), float("inf")


def top_k(
    df: DataFrame,
    k: int,
    partition: Sequence[str] = ("user_id",),
    score: str = "score",
    tie: str = "item_id",
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows per group by (score DESC, tie ASC).

    ``row_number() <= k`` is planned as a group limit before the shuffle, so a
    hot group never reaches its task whole.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*partition).orderBy(order_score(score).desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def quantile_bucket(
    df: DataFrame, column: str, buckets: int, name: str, source: DataFrame | None = None
) -> DataFrame:
    """Add an order-preserving bucket number for ``column``; buckets hold similar row counts.

    The cuts come from ``source`` when given, a cheaper table with the same values.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = (source or df).select(F.col(column).cast("double").alias(column)).stat.approxQuantile(
        column, probabilities, 0.01
    )
    splits = [NEG_INF, *sorted(set(cuts)), POS_INF]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)


def even_cuts(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner borders of at most ``buckets`` ranges of ``column`` that hold similar row counts."""
    if buckets <= 1:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.select(F.col(column).cast("double").alias(column)).stat.approxQuantile(column, probabilities, 0.1 / buckets)))


def bucketed(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the number of the range between ``even_cuts`` that ``column`` falls into."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    value = df.withColumn("__value", F.col(column).cast("double"))
    numbers = Bucketizer(splits=[NEG_INF, *cuts, POS_INF], inputCol="__value", outputCol="__range").transform(value)
    return numbers.withColumn(name, F.col("__range").cast("int")).drop("__value", "__range")


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    buckets: Sequence[tuple[str, bool]],
    partition: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Dense 1-based numbering of the rows of each ``partition`` in ``order``.

    ``buckets`` lists coarse columns, each with its descending flag, whose order
    agrees with ``order``. Rows are numbered inside their bucket, and the bucket
    counts supply the offsets, level by level: a window holds the values of one
    coarse column inside one value of those before it. So no task sorts a whole
    group, however large it is.
    """
    names = [b for b, _ in buckets]
    keys = [*partition, *names]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = F.lit(0)
    for level, (b, desc) in enumerate(buckets):
        outer = [*partition, *names[:level]]
        before = Window.partitionBy(*outer).orderBy(F.col(b).desc() if desc else F.col(b).asc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = counts if level == len(buckets) - 1 else counts.groupBy(*outer, b).agg(F.sum("__n").alias("__n"))
        sums = sums.select(*outer, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__before{level}"))
        offsets = sums if level == 0 else offsets.join(sums, outer)
        total = total + F.col(f"__before{level}")
    offsets = offsets.select(*keys, total.alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__in", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(name, (F.col("__in") + F.col("__before")).cast("bigint"))
        .drop("__in", "__before")
    )


def numbered_by_draw(df: DataFrame, draw_col: str, tie: str, partition: Sequence[str] = (), name: str = "position"):
    """``numbered`` for a uniform 32-bit draw: its high bits are balanced buckets."""
    coarse = df.withColumn("__b", F.shiftright(F.col(draw_col), 22))
    return numbered(coarse, [F.col(draw_col), F.col(tie)], [("__b", False)], partition, name).drop("__b")


def numbered_by_id(
    df: DataFrame, column: str, descending: bool = False, buckets: int = 256, partition: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """``numbered`` for a unique numeric id."""
    coarse = quantile_bucket(df, column, buckets, "__b")
    order = F.col(column).desc() if descending else F.col(column).asc()
    return numbered(coarse, [order], [("__b", descending)], partition, name).drop("__b")


def _order_statistics(df: DataFrame, value: str, group: Sequence[str], buckets: int) -> tuple[DataFrame, list[str]]:
    """Distinct values with their running count and the group total, cumulated bucket by bucket."""
    keys = list(group) or ["__all"]
    present = df.filter(F.col(value).isNotNull())
    if not group:
        present = present.withColumn("__all", F.lit(0))
    counts = present.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    coarse = quantile_bucket(counts, "__v", buckets, "__b")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = coarse.groupBy(*keys, "__b").agg(F.sum("__c").alias("__n"))
    offsets = totals.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    running = coarse.join(offsets, [*keys, "__b"]).withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    return running, keys


def nearest_rank(
    df: DataFrame, value: str, positions: dict[str, float], group: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """Exact value at sorted index ``min(n - 1, floor(p * n))`` per group.

    This is neither an interpolated nor a discrete SQL percentile. NULL values
    are left out; a group without values gives no row.
    """
    running, keys = _order_statistics(df, value, group, buckets)
    picks = []
    for label, p in positions.items():
        index = F.least(F.col("__total") - 1, F.floor(F.lit(p) * F.col("__total")))
        picks.append(F.min(F.when(F.col("__upto") > index, F.col("__v"))).alias(label))
    result = running.groupBy(*keys).agg(*picks)
    return result if group else result.drop("__all")


def linear_percentile(
    df: DataFrame, value: str, positions: dict[str, float], group: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """Exact percentile with linear interpolation between the two nearest order statistics."""
    running, keys = _order_statistics(df, value, group, buckets)
    picks = []
    for label, p in positions.items():
        at = F.lit(p) * (F.col("__total") - 1)
        low = F.min(F.when(F.col("__upto") > F.floor(at), F.col("__v")))
        high = F.min(F.when(F.col("__upto") > F.ceil(at), F.col("__v")))
        share = F.max(at - F.floor(at))
        picks.append((low + share * (high - low)).alias(label))
    result = running.groupBy(*keys).agg(*picks)
    return result if group else result.drop("__all")
