"""Scorer registry: a name to a function from the split to a top-k ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recspark.operators import als, bpr, graph, itemcf, popularity
from recspark.operators.metrics import score_ranking
from recspark.session import stored


@dataclass(frozen=True)
class Split:
    """What a direct scorer may see: legal training rows, their histories, users and the catalog."""

    train: DataFrame
    history: DataFrame
    users: DataFrame
    items: DataFrame
    params: dict


Scorer = Callable[[Split], DataFrame]
SCORERS: dict[str, Scorer] = {}


def register(name: str) -> Callable[[Scorer], Scorer]:
    """Register a scorer returning ``(user_id, item_id, rank)``; a taken name is refused."""

    def keep(fn: Scorer) -> Scorer:
        if name in SCORERS:
            raise ValueError(f"scorer name is taken: {name}")
        SCORERS[name] = fn
        return fn

    return keep


@register("popularity")
def _popularity(s: Split) -> DataFrame:
    return popularity.popularity_topk(s.train, s.items, s.users, s.history, 10)


@register("itemcf_direct")
def _itemcf(s: Split) -> DataFrame:
    return itemcf.itemcf_direct(itemcf.itemcf_fit(s.train), s.history, s.users, s.items, 10)


@register("als_direct")
def _als(s: Split) -> DataFrame:
    p = {"rank": 20, "iterations": 12, "alpha": 40.0, "reg": 0.1, **s.params.get("als_direct", {})}
    factors = als.als_fit(s.train, **p)
    mine = s.history.join(s.users.select("user_id"), "user_id", "left_semi")
    known = factors.join(s.items.select("item_id"), "item_id", "left_semi")
    users = als.als_user_factors(factors, mine, p["rank"], p["alpha"], p["reg"])
    return als.block_topk(
        users.select("user_id", F.col("factor").alias("weights")), known.select("item_id", F.col("factor").alias("weights")), 10, mine
    )


@register("bpr_mf")
def _bpr(s: Split) -> DataFrame:
    users, items = bpr.bpr_fit(s.train, **s.params.get("bpr_mf", {}))
    return bpr.factor_topk(users.join(s.users.select("user_id"), "user_id", "left_semi"), items, s.items, 10, s.history)


@register("lightgcn")
def _lightgcn(s: Split) -> DataFrame:
    users, items = graph.lightgcn_fit(s.train, **s.params.get("lightgcn", {}))
    return bpr.factor_topk(users.join(s.users.select("user_id"), "user_id", "left_semi"), items, s.items, 10, s.history)


def evaluate(names: list[str], split: Split, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(per-user metrics, top-10 rows)`` of the named scorers, with a ``method`` column."""
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers: {unknown}")
    metrics, tops = [], []
    for n in names:
        top = stored(SCORERS[n](split).select("user_id", "item_id", "rank"), "top")
        metrics.append(score_ranking(top, targets, split.history, split.items).withColumn("method", F.lit(n)))
        tops.append(top.withColumn("method", F.lit(n)))
    return reduce(DataFrame.unionByName, metrics), reduce(DataFrame.unionByName, tops)
