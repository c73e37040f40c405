"""Route score normalization and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recspark.functions.ordering import top_k
from recspark.functions.portable import order_score
from recspark.operators.candidates import affinity, candidate_union

# fixed values: fusion kinds, default weights and constant, report texts
KINDS = ("itemcf", "minmax_linear", "rrf", "percentile_linear")
DEFAULT_WEIGHTS, DEFAULT_RRF_K = (0.5, 0.3, 0.2), 60
DEFAULT_REASON = "Selected by collaborative and semantic relevance."
ISCLOSE = 1e-9


def _minmax(score: Column, low: Column, high: Column) -> Column:
    flat = F.abs(high - low) <= ISCLOSE * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, F.lit(1.0)).otherwise((score - low) / (high - low))


def minmax_normalize(scores: DataFrame) -> DataFrame:
    """Per-user min-max; equal scores all become 1."""
    w = Window.partitionBy("user_id")
    value = _minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    return scores.withColumn("normalized", value)


def rrf_scores(scores: DataFrame, k: int = DEFAULT_RRF_K) -> DataFrame:
    """Reciprocal rank score ``1 / (k + rank)``."""
    if k <= 0:
        raise ValueError("rrf k must be positive")
    w = Window.partitionBy("user_id").orderBy(order_score("score").desc(), F.col("item_id"))
    return scores.withColumn("rrf", 1.0 / (F.row_number().over(w) + F.lit(k)))


def percentile_scores(scores: DataFrame) -> DataFrame:
    """``1 - first index / (n - 1)``; a singleton scores 1."""
    w = Window.partitionBy("user_id").orderBy(order_score("score").desc())
    return scores.withColumn("percentile", 1.0 - F.percent_rank().over(w))


def route_values(union: DataFrame, route: str, rrf_ks: tuple[int, ...] = ()) -> DataFrame:
    """Add min-max, percentile and RRF values of one route to union rows; 0 for non-members."""
    member = F.col(f"in_{route}")
    w = Window.partitionBy("user_id", f"in_{route}")
    score, rank = F.col(f"{route}_score"), F.col(f"{route}_rank")
    zero = F.lit(0.0)
    out = union.withColumn(
        f"{route}_minmax", F.when(member, _minmax(score, F.min(score).over(w), F.max(score).over(w))).otherwise(zero)
    ).withColumn(
        f"{route}_percentile",
        F.when(member, 1.0 - F.percent_rank().over(w.orderBy(order_score(f"{route}_score").desc()))).otherwise(zero),
    )
    for k in rrf_ks:
        out = out.withColumn(f"{route}_rrf{k}", F.when(member, 1.0 / (rank + F.lit(k))).otherwise(zero))
    return out


def fuse(
    kind: str, itemcf: DataFrame, semantic: DataFrame, items: DataFrame, states: DataFrame | None = None,
    weights: tuple[float, float, float] = DEFAULT_WEIGHTS, rrf_k: int = DEFAULT_RRF_K, k: int = 10,
) -> DataFrame:
    """Top ``k`` per user with the route, preference and final scores.

    Routes are ``(user_id, item_id, score, rank)``. ``itemcf`` ranks only that
    route; the others rank the union. Without ``states`` no genre is preferred.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown ranker kind: {kind}")
    if kind == "rrf" and rrf_k <= 0:
        raise ValueError("rrf k must be positive")
    union = candidate_union(itemcf=itemcf, semantic=None if kind == "itemcf" else semantic)
    rows = union.join(items.select("item_id", "genres"), "item_id")
    liked = disliked = F.lit(0)
    if states is not None:
        rows = rows.join(states, "user_id", "left")
        count = lambda c: F.coalesce(F.size(F.array_intersect("genres", c)), F.lit(0)) if c in states.columns else F.lit(0)
        liked, disliked = count("liked_genres"), count("disliked_genres")
    preference = affinity(liked, disliked, F.lit(0.0), F.lit(0.0))
    zero = F.lit(0.0)
    if kind == "itemcf":
        cf, sem = F.coalesce("itemcf_score", zero), zero
    else:
        for route in ("itemcf", "semantic"):
            rows = route_values(rows, route, (rrf_k,))
        suffix = {"minmax_linear": "minmax", "percentile_linear": "percentile", "rrf": f"rrf{rrf_k}"}[kind]
        cf, sem = F.col(f"itemcf_{suffix}"), F.col(f"semantic_{suffix}")
    a, b, c = weights
    final = {"itemcf": cf, "rrf": cf + sem}.get(kind, a * cf + b * sem + c * preference)
    scored = rows.select(
        "user_id", "item_id", cf.alias("itemcf"), sem.alias("semantic"), preference.alias("preference"), final.alias("score")
    )
    return top_k(scored, k)


def explain_reason(recs: DataFrame, items: DataFrame, states: DataFrame) -> DataFrame:
    """Sentence naming the matched liked genres, or the default sentence."""
    rows = recs.join(items.select("item_id", "genres"), "item_id").join(states.select("user_id", "liked_genres"), "user_id", "left")
    matched = F.array_sort(F.array_distinct(F.array_intersect("genres", "liked_genres")))
    text = F.when(
        F.size(matched) > 0, F.concat(F.lit("Matches preferred genres: "), F.array_join(matched, ", "), F.lit("."))
    ).otherwise(F.lit(DEFAULT_REASON))
    return rows.select(*recs.columns, text.alias("reason"))
