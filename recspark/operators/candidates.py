"""Candidate union and feature rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recspark.functions.portable import order_score
from recspark.operators.splits import POSITIVE_THRESHOLD

# fixed values: feature columns of each version, in order
FEATURES_V1 = (
    "itemcf_score",
    "itemcf_reciprocal_rank",
    "dense_score",
    "dense_reciprocal_rank",
    "log1p_popularity",
    "history_genre_jaccard",
    "history_year_match",
    "preference_affinity",
    "in_itemcf",
    "in_dense",
)
FEATURES_V2 = (*FEATURES_V1, "latent_score", "latent_reciprocal_rank", "in_latent")
FEATURES_V2B = (*FEATURES_V2, "itemcf_latent_cross", "recent_itemcf_score", "year_recency")
FEATURES = {"v1": FEATURES_V1, "v2": FEATURES_V2, "v2b": FEATURES_V2B}


def candidate_union(**routes: DataFrame | None) -> DataFrame:
    """Union of the routes, one row per (user, item), with score, rank and flag per route.

    Routes are stacked and pivoted by one aggregation: one shuffle, not a chain
    of full outer joins. A missing route member has score and rank NULL.
    """
    names = [n for n, r in routes.items() if r is not None]
    stacked = reduce(
        DataFrame.unionByName,
        [routes[n].select("user_id", "item_id", "score", "rank", F.lit(n).alias("route")) for n in names],
    )
    picks = []
    for n in routes:
        at = F.col("route") == n
        picks += [
            F.max(F.when(at, F.col("score"))).alias(f"{n}_score"),
            F.max(F.when(at, F.col("rank"))).alias(f"{n}_rank"),
            F.coalesce(F.bool_or(at), F.lit(False)).alias(f"in_{n}"),
        ]
    return stacked.groupBy("user_id", "item_id").agg(*picks)


def route_rank(scores: DataFrame) -> DataFrame:
    """1-based rank by (score DESC, item ASC) and its reciprocal."""
    w = Window.partitionBy("user_id").orderBy(order_score("score").desc(), F.col("item_id"))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("reciprocal_rank", 1.0 / F.col("rank"))


def route_percentile(scores: DataFrame) -> DataFrame:
    """``(n - competition rank + 1) / n`` within each user's route."""
    per_user = Window.partitionBy("user_id")
    place = F.rank().over(per_user.orderBy(order_score("score").desc()))
    n = F.count(F.lit(1)).over(per_user)
    return scores.withColumn("percentile", (n - place + 1) / n)


def affinity(liked: Column, disliked: Column, liked_item: Column, disliked_item: Column) -> Column:
    raw = F.lit(0.5) + 0.25 * liked - 0.5 * disliked + 0.5 * liked_item - disliked_item
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def affinity_feature(pairs: DataFrame, items: DataFrame, states: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Clamped preference affinity; ``marks(user_id, item_id, liked, disliked)`` adds the item terms."""
    rows = pairs.select("user_id", "item_id").join(items.select("item_id", "genres"), "item_id").join(states, "user_id", "left")
    zero = F.lit(0.0)
    liked_item = disliked_item = zero
    if marks is not None:
        rows = rows.join(marks.select("user_id", "item_id", "liked", "disliked"), ["user_id", "item_id"], "left")
        liked_item = F.coalesce(F.col("liked").cast("double"), zero)
        disliked_item = F.coalesce(F.col("disliked").cast("double"), zero)
    count = lambda c: F.coalesce(F.size(F.array_intersect("genres", c)), F.lit(0))
    has = lambda c: count(c) if c in states.columns else F.lit(0)
    value = affinity(has("liked_genres"), has("disliked_genres"), liked_item, disliked_item)
    return rows.select("user_id", "item_id", value.alias("affinity"))


def affinity_fusion(pairs: DataFrame, items: DataFrame, states: DataFrame) -> DataFrame:
    """Genre affinity only: 0.5 when no genre matches, else the clamped sum."""
    return affinity_feature(pairs, items, states)


def median_year(hist: DataFrame, items: DataFrame) -> DataFrame:
    """Upper-middle release year of the history rows, duplicates included, from per-year counts."""
    dated = hist.select("user_id", "item_id").join(items.select("item_id", "year"), "item_id").filter("year IS NOT NULL")
    counts = dated.groupBy("user_id", "year").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("user_id")
    running = counts.withColumn("upto", F.sum("c").over(w.orderBy("year"))).withColumn("n", F.sum("c").over(w))
    middle = running.filter(F.col("upto") > F.floor(F.col("n") / 2))
    return middle.groupBy("user_id").agg(F.min("year").alias("median_year"))


def history_profile(hist: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: genres, years and median year of the history. All bounded by the vocabulary."""
    rows = hist.select("user_id", "item_id").join(items.select("item_id", "genres", "year"), "item_id")
    genres = rows.select("user_id", F.explode("genres").alias("g")).groupBy("user_id").agg(F.collect_set("g").alias("hist_genres"))
    years = rows.groupBy("user_id").agg(F.collect_set("year").alias("hist_years"))
    return years.join(genres, "user_id", "left").join(median_year(hist, items), "user_id", "left")


def _calibrated(union: DataFrame, routes: list[str], calibration: str) -> DataFrame:
    if calibration == "raw":
        return union
    if calibration != "percentile":
        raise ValueError("calibration must be raw or percentile")
    for r in routes:
        member = Window.partitionBy("user_id", f"in_{r}")
        place = F.rank().over(member.orderBy(order_score(f"{r}_score").desc()))
        n = F.count(F.lit(1)).over(member)
        union = union.withColumn(f"{r}_percentile", F.when(F.col(f"in_{r}"), (n - place + 1) / n))
        union = union.withColumn(f"{r}_score", F.col(f"{r}_percentile")).drop(f"{r}_percentile")
    return union


def candidate_features(
    union: DataFrame, items: DataFrame, hist: DataFrame, stats: DataFrame, states: DataFrame, recent: DataFrame | None = None,
    calibration: str = "raw", version: str = "v1", marks: DataFrame | None = None,
) -> DataFrame:
    """One DOUBLE column per feature for every candidate on the catalog.

    ``hist`` are the user's legal history rows, ``stats`` the legal training
    rows behind the popularity counts, ``states`` the liked genres and, if it has
    the column, the disliked ones; ``marks(user_id, item_id, liked, disliked)`` adds
    the affinity's item terms. Popularity and the per-user profile are computed
    once for all users.
    """
    if version not in FEATURES:
        raise ValueError("version must be v1, v2 or v2b")
    routes = [r for r in ("itemcf", "dense", "latent") if f"in_{r}" in union.columns]
    if version != "v1" and "latent" not in routes:
        raise ValueError("versions v2 and v2b need a latent route")
    base = _calibrated(union, routes, calibration)
    pop = stats.filter(F.col("rating") >= POSITIVE_THRESHOLD).groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))
    tastes = [c for c in ("liked_genres", "disliked_genres") if c in states.columns]
    rows = (
        base.join(items.select("item_id", "genres", "year"), "item_id")
        .join(pop, "item_id", "left")
        .join(history_profile(hist, items), "user_id", "left")
        .join(states.select("user_id", *tastes), "user_id", "left")
    )
    liked_item = disliked_item = F.lit(0.0)
    if marks is not None:
        rows = rows.join(marks.select("user_id", "item_id", "liked", "disliked"), ["user_id", "item_id"], "left")
        liked_item = F.coalesce(F.col("liked").cast("double"), F.lit(0.0))
        disliked_item = F.coalesce(F.col("disliked").cast("double"), F.lit(0.0))
    no_names = F.array().cast("array<string>")
    mine = F.coalesce("hist_genres", no_names)
    union_size = F.size(F.array_union(mine, F.col("genres")))
    jaccard = F.when(union_size > 0, F.size(F.array_intersect(mine, F.col("genres"))) / union_size).otherwise(F.lit(0.0))
    year_match = F.coalesce(F.array_contains("hist_years", F.col("year")), F.lit(False)).cast("double")
    count = lambda c: F.size(F.array_intersect("genres", F.coalesce(c, no_names))) if c in tastes else F.lit(0)
    zero = F.lit(0.0)
    score = lambda r: F.coalesce(F.col(f"{r}_score"), zero)
    reciprocal = lambda r: F.coalesce(1.0 / F.col(f"{r}_rank"), zero)
    values = {
        "itemcf_score": score("itemcf"),
        "itemcf_reciprocal_rank": reciprocal("itemcf"),
        "dense_score": score("dense"),
        "dense_reciprocal_rank": reciprocal("dense"),
        "log1p_popularity": F.log1p(F.coalesce("popularity", F.lit(0))),
        "history_genre_jaccard": jaccard,
        "history_year_match": year_match,
        "preference_affinity": affinity(count("liked_genres"), count("disliked_genres"), liked_item, disliked_item),
        "in_itemcf": F.col("in_itemcf").cast("double"),
        "in_dense": F.col("in_dense").cast("double"),
    }
    if version != "v1":
        values |= {
            "latent_score": score("latent"),
            "latent_reciprocal_rank": reciprocal("latent"),
            "in_latent": F.col("in_latent").cast("double"),
        }
    if version == "v2b":
        if recent is None:
            raise ValueError("version v2b needs recent ItemCF scores")
        late = recent.select("user_id", "item_id", F.col("score").alias("recent_score"))
        rows = rows.join(late, ["user_id", "item_id"], "left")
        values |= {
            "itemcf_latent_cross": score("itemcf") * score("latent"),
            "recent_itemcf_score": F.coalesce("recent_score", zero),
            "year_recency": F.coalesce(F.abs(F.col("year") - F.col("median_year")).cast("double"), zero),
        }
    return rows.select("user_id", "item_id", *[v.cast("double").alias(n) for n, v in values.items()])
