"""Item-to-item collaborative filtering: fit, retrieve, score."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from recspark.functions.ordering import top_k
from recspark.operators import itemcf_blocks as blocks
from recspark.operators.popularity import catalog_order, first_unseen, popularity
from recspark.operators.splits import POSITIVE_THRESHOLD, positives
from recspark.session import stored

CHUNK = 512  # liked items that one row holds
TASK_PAIRS = 2_000_000  # pairs of liked items that one task counts on average


@dataclass(frozen=True)
class ItemCF:
    """``sim(src, dst, score)`` of every pair of items that some user likes, and popularity."""

    sim: DataFrame
    pop: DataFrame


def co_likes(likes: DataFrame, chunk: int = CHUNK, *carry: str) -> DataFrame:
    """``(a, b)`` with a < b for each user and pair of liked items, and the user's ``carry`` columns.

    A user's likes are cut into chunks in item order, and each pair of chunks emits
    its pairs of items from a row of its own. Every user takes this path, no row
    holds more than two chunks, and the result is the same for any chunk size. The rows
    are dealt to as many tasks as it takes for ``TASK_PAIRS`` pairs a task: what a
    task counts is bounded by its pairs, of which few bytes of likes make many.
    """
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")) - 1
    baskets = likes.withColumn("chunk", F.floor(place / chunk)).groupBy("user_id", "chunk", *carry).agg(
        F.sort_array(F.collect_list("item_id")).alias("basket"))
    baskets = stored(baskets, "baskets")
    likes_of = baskets.groupBy("user_id").agg(F.sum(F.size("basket")).alias("n"))
    pairs = likes_of.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    first = baskets.select("user_id", F.col("chunk").alias("ca"), F.col("basket").alias("left"))
    met = first.join(baskets, "user_id").where("ca <= chunk").select(
        "user_id", "ca", "chunk", F.when(F.col("ca") < F.col("chunk"), F.col("left")).alias("left"), "basket", *carry)
    met = met.repartition(max(1, math.ceil(pairs / TASK_PAIRS)), "user_id", "ca", "chunk")
    sided = met.select("ca", "chunk", "basket", *carry, F.posexplode(F.coalesce("left", "basket")).alias("i", "a"))
    later = F.when(F.col("ca") == F.col("chunk"), F.slice("basket", F.col("i") + 2, F.size("basket"))).otherwise(F.col("basket"))
    return sided.select("a", F.explode(later).alias("b"), *carry)


def with_popularity(counts: DataFrame, pop: DataFrame) -> DataFrame:
    """``(a, b, c, pa, pb)``: each pair's co-likes and the popularity of both items."""
    pa = pop.select(F.col("item_id").alias("a"), F.col("popularity").alias("pa"))
    pb = pop.select(F.col("item_id").alias("b"), F.col("popularity").alias("pb"))
    return counts.join(pa, "a").join(pb, "b").select("a", "b", "c", "pa", "pb")


def both_ways(halves: DataFrame) -> DataFrame:
    """``(src, dst, score)`` in both directions from rows of ``with_popularity``."""
    half = halves.select("a", "b", (F.col("c") / F.sqrt(F.col("pa") * F.col("pb"))).alias("score"))
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
            F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
        )
    )
    return half.select(both.alias("e"), "score").select("e.src", "e.dst", "score")


def similarities(counts: DataFrame, pop: DataFrame) -> DataFrame:
    """``(src, dst, score)`` in both directions from ``counts(a, b, c)``."""
    return both_ways(with_popularity(counts, pop))


def itemcf_fit(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD, chunk: int = CHUNK) -> ItemCF:
    """Cosine of co-like counts, ``c_ij / sqrt(p_i * p_j)``; popularity counts rows, co-likes distinct items."""
    pop = popularity(inter, threshold)
    return ItemCF(similarities(pair_counts(inter, threshold, chunk), pop), pop)


def pair_counts(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``(a, b, c)``: how many users like both items."""
    likes = positives(inter, threshold).select("user_id", "item_id").distinct()
    return co_likes(likes, chunk).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def itemcf_stored(inter: DataFrame, threshold: int = POSITIVE_THRESHOLD, chunk: int = CHUNK) -> ItemCF:
    """``itemcf_fit`` written once. Each pair is stored in one direction, with its counts:
    small whole numbers take a fraction of the space of the scores of both directions,
    which are made of them where they are read."""
    pop = stored(popularity(inter, threshold), "pop")
    return ItemCF(both_ways(stored(with_popularity(pair_counts(inter, threshold, chunk), pop), "pairs")), pop)


def fold_models(inter: DataFrame, folds: DataFrame, n: int, threshold: int = POSITIVE_THRESHOLD, chunk: int = CHUNK) -> list[ItemCF]:
    """For each of ``n`` folds the model fitted on the users of the other folds.

    ``folds(user_id, fold)`` has one fold per user; other users enter no fit. All co-likes
    are counted in one pass, whole and per held-out fold, and written once. A fold's
    statistics are the totals less what its users added, so no fold counts pairs again.
    """
    rows = positives(inter, threshold).join(folds.select("user_id", "fold"), "user_id")
    counted = [F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("fold") == f).alias(f"held{f}") for f in range(n)]]
    pops = stored(rows.groupBy("item_id").agg(*counted), "fold-popularity")
    likes = rows.select("user_id", "item_id", "fold").distinct()
    counts = stored(co_likes(likes, chunk, "fold").groupBy("a", "b").agg(*counted), "fold-counts")

    def model(fold: int) -> ItemCF:
        rest = F.col("all") - F.col(f"held{fold}")
        pop = pops.select("item_id", rest.alias("popularity")).filter("popularity > 0")
        return ItemCF(similarities(counts.select("a", "b", rest.alias("c")).filter("c > 0"), pop), pop)

    return [model(f) for f in range(n)]


def without(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The users without any unseen neighbour in the cells' rows."""
    linked = rows.filter("item_id IS NULL").select("user_id").distinct()
    return users.select("user_id").distinct().join(linked, "user_id", "left_anti")


def itemcf_retrieve(
    model: ItemCF, hist: DataFrame, users: DataFrame, items: DataFrame, k: int = 100, states: DataFrame | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` unseen catalog items per user; popularity for users without any neighbour.

    ``states`` holds hard constraints and ``blocked(user_id, item_id)`` further ids that
    may not be returned; both act before the k. The fallback looks at neighbours before
    them, so a user whose neighbours are all filtered gets no rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = blocks.found(model.sim, model.pop, items, blocks.requests(users, hist, blocked, states), k, "neighbours")
    result = rows.filter("item_id IS NOT NULL")
    lonely = stored(without(rows, users), "lonely")
    if not lonely.isEmpty():
        asked = blocks.requests(lonely, hist, blocked, states, popular=True)
        result = result.unionByName(top_k(blocks.popular_first(model.pop, items, asked, k), k))
    return result


def itemcf_score(model: ItemCF, hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of the requested (user, item) pairs; 0.0 where an item is no neighbour."""
    wanted = pairs.select("user_id", "item_id").distinct()
    nothing = wanted.select("item_id").filter(F.lit(False))
    rows = blocks.found(model.sim, model.pop, nothing, blocks.requests(wanted, hist, wanted=wanted), None, "scores")
    popular = (
        wanted.join(without(rows, wanted), "user_id", "left_semi")
        .join(hist.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
        .join(model.pop, "item_id")
        .select("user_id", "item_id", F.col("popularity").cast("double").alias("score"))
    )
    scores = rows.filter("item_id IS NOT NULL").unionByName(popular)
    return wanted.join(scores, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def itemcf_direct(model: ItemCF, hist: DataFrame, users: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Every unseen catalog item competes: neighbours by score, the others with 0.0 by id."""
    scored = itemcf_retrieve(model, hist, users, items, k).select("user_id", "item_id", "score")
    nothing = model.pop.filter(F.lit(False))
    zeros = first_unseen(users, catalog_order(items, nothing), hist, 2 * k).select(
        "user_id", "item_id", F.lit(0.0).alias("score")
    )
    merged = scored.unionByName(zeros).groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    return top_k(merged, k)


def recent_history(hist: DataFrame, n: int = 10) -> DataFrame:
    """Distinct items among each user's last ``n`` history rows by (ts, item)."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc(), F.col("row_key").desc())
    last = hist.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
    return last.select("user_id", "item_id").distinct()


def recent_itemcf(model: ItemCF, hist: DataFrame, candidates: DataFrame, n: int = 10) -> DataFrame:
    return itemcf_score(model, recent_history(hist, n), candidates)


def held_out_retrieve(model: ItemCF, rows: DataFrame, hist: DataFrame, users: DataFrame, items: DataFrame, k: int = 100,
                      threshold: int = POSITIVE_THRESHOLD) -> DataFrame:
    """ItemCF of every case as if the case user's unseen rows were not in the fit.

    ``model`` is fitted on all ``rows``. A user's liked items outside ``hist``
    are hidden: such an item loses this user's rows from its popularity and one
    co-like with every history item. That corrects the finished sums of just the
    hidden (user, item) pairs, so nothing is refitted per case.
    """
    seen = hist.select("user_id", "item_id").distinct()
    likes = positives(rows, threshold).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("own"))
    hidden = likes.join(users.select("user_id"), "user_id", "left_semi").join(seen, ["user_id", "item_id"], "left_anti")
    pop = model.pop
    weight = (
        seen.join(likes, ["user_id", "item_id"], "left_semi")
        .join(pop, "item_id")
        .groupBy("user_id")
        .agg(F.sum(1 / F.sqrt("popularity")).alias("w"))
    )
    corrected = hidden.join(weight, "user_id", "left").select("user_id", "item_id", "own", F.coalesce("w", F.lit(0.0)).alias("weight"))
    rows = blocks.found(model.sim, pop, items, blocks.requests(users, seen, hidden=corrected), k, "held-out")
    lonely = stored(without(rows, users), "lonely")
    popular = lonely_popular(lonely, pop, hidden, seen, items, k)
    kept = popular.join(items.select("item_id"), "item_id", "left_semi").select("user_id", "item_id", "score")
    return top_k(rows.filter("item_id IS NOT NULL").drop("rank").unionByName(kept), k)


def lonely_popular(lonely: DataFrame, pop: DataFrame, hidden: DataFrame, seen: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Popularity fallback with the user's own hidden rows taken off.

    Only hidden items change, and only downwards: the first ``k`` unseen items
    that are not hidden, plus the hidden ones, hold the top ``k``.
    """
    order = catalog_order(items.join(pop, "item_id", "left_semi"), pop)
    skip = seen.unionByName(hidden.select("user_id", "item_id"))
    stable = first_unseen(lonely, order, skip, k).select("user_id", "item_id", "score")
    own = (
        hidden.join(lonely, "user_id", "left_semi")
        .join(pop, "item_id")
        .select("user_id", "item_id", (F.col("popularity") - F.col("own")).cast("double").alias("score"))
        .filter("score > 0")
    )
    return stable.unionByName(own)
