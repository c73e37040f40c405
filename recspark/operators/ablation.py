"""Parameter sweeps and diagnostics over stored routes.

Every sweep needs only the rank of one target per user and setting. That rank is
one plus the number of candidates ahead of the target, so all settings are
columns of a single aggregate: no grid is multiplied into the candidate rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recspark.functions.ordering import nearest_rank
from recspark.functions.portable import order_score
from recspark.operators.candidates import candidate_union
from recspark.operators.fusion import _minmax, route_values
from recspark.operators.metrics import gain


def target_ranks(rows: DataFrame, targets: DataFrame, scores: dict[str, Column], by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Rank of each user's target under every score; NULL when the score of the target is NULL or absent.

    A candidate takes part under a score only where that score is not NULL.
    """
    goal = targets.select("user_id", F.col("item_id").alias("target"))
    named = rows.select(*by, "item_id", *[order_score(c).alias(n) for n, c in scores.items()])
    mine = named.join(goal, "user_id").filter(F.col("item_id") == F.col("target"))
    mine = mine.select(*by, "target", *[F.col(n).alias(f"t_{n}") for n in scores])
    ahead = []
    for n in scores:
        s, t = F.col(n), F.col(f"t_{n}")
        better = (s > t) | ((s == t) & (F.col("item_id") < F.col("target")))
        ahead.append((F.when(F.first(t).isNotNull(), F.count_if(better) + 1)).alias(n))
    return named.join(mine, list(by)).groupBy(*by).agg(*ahead)


def _hit(rank: Column, k: int = 10) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def _ndcg(rank: Column, k: int = 10) -> Column:
    return F.when(rank <= k, gain(rank)).otherwise(0.0)


def rank_summary(ranks: DataFrame, users: int, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean NDCG@10 and hit rate@10 per setting; users without a rank count as 0."""
    sums = ranks.groupBy(*by).agg(
        *[F.sum(_ndcg(F.col(n))).alias(f"n_{n}") for n in names], *[F.sum(_hit(F.col(n))).alias(f"h_{n}") for n in names]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("setting"),
                (F.coalesce(F.col(f"n_{n}"), F.lit(0.0)) / users).alias("ndcg_at_10"),
                (F.coalesce(F.col(f"h_{n}"), F.lit(0.0)) / users).alias("recall_at_10"),
            )
            for n in names
        ]
    )
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def simplex(step: float) -> list[tuple[int, int, int]]:
    """Integer weight triples that sum to ``1 / step`` units."""
    units = round(1 / step)
    return [(a, b, units - a - b) for a in range(units + 1) for b in range(units + 1 - a)]


def tune_weights(
    itemcf: DataFrame, semantic: DataFrame, preference: DataFrame, targets: DataFrame, step: float = 0.1
) -> DataFrame:
    """Mean NDCG@10 of every weight triple; ``selected`` marks the best.

    ``preference(user_id, item_id, preference)`` scores candidates. Ties prefer
    the larger second, then the larger first weight.
    """
    rows = candidate_union(itemcf=itemcf, semantic=semantic)
    for route in ("itemcf", "semantic"):
        rows = route_values(rows, route)
    rows = rows.join(preference, ["user_id", "item_id"], "left").fillna(0.0, ["preference"])
    grid = {f"w_{a}_{b}_{c}": (a * step, b * step, c * step) for a, b, c in simplex(step)}
    scores = {
        n: F.lit(a) * F.col("itemcf_minmax") + F.lit(b) * F.col("semantic_minmax") + F.lit(c) * F.col("preference")
        for n, (a, b, c) in grid.items()
    }
    table = rank_summary(target_ranks(rows, targets, scores), targets.count(), list(grid))
    unit = F.split("setting", "_")
    weights = table.select(
        *[F.get(unit, F.lit(i + 1)).cast("bigint").alias(f"w{i + 1}") for i in range(3)], "ndcg_at_10"
    )
    best = Window.orderBy(order_score("ndcg_at_10").desc(), F.col("w2").desc(), F.col("w1").desc())  # grid size rows
    return weights.withColumn("selected", F.row_number().over(best) == 1)


def retrieval_ablation(
    itemcf: DataFrame, semantic_by_cap: dict[int, DataFrame], targets: DataFrame, depths: Sequence[int] = (100, 200, 500),
    weights: tuple[float, float] = (0.7, 0.3),
) -> DataFrame:
    """Candidate recalls and fused NDCG@10 for every (depth, history cap); ``selected`` marks the best.

    Routes come at the greatest depth and are cut by rank. Ties prefer higher
    union recall, then smaller depth, then smaller cap.
    """
    users = targets.count()
    tables = []
    for cap, semantic in semantic_by_cap.items():
        rows = candidate_union(itemcf=itemcf, semantic=semantic)
        per_user = Window.partitionBy("user_id")
        scores = {}
        for d in depths:
            parts = []
            for route in ("itemcf", "semantic"):
                inside = F.col(f"{route}_rank") <= d
                s = F.when(inside, F.col(f"{route}_score"))
                rows = rows.withColumn(f"{route}_{d}", F.when(s.isNotNull(), _minmax(s, F.min(s).over(per_user), F.max(s).over(per_user))))
                parts.append(F.col(f"{route}_{d}"))
            member = parts[0].isNotNull() | parts[1].isNotNull()
            fused = weights[0] * F.coalesce(parts[0], F.lit(0.0)) + weights[1] * F.coalesce(parts[1], F.lit(0.0))
            scores[f"d{d}"] = F.when(member, fused)
        ndcg = rank_summary(target_ranks(rows, targets, scores), users, list(scores))
        goal = rows.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
        recalls = goal.agg(
            *[F.count_if(F.col("itemcf_rank") <= d).alias(f"c{d}") for d in depths],
            *[F.count_if(F.col("semantic_rank") <= d).alias(f"s{d}") for d in depths],
            *[F.count_if((F.col("itemcf_rank") <= d) | (F.col("semantic_rank") <= d)).alias(f"u{d}") for d in depths],
        )
        cells = F.array(*[
            F.struct(F.lit(f"d{d}").alias("setting"), F.lit(d).alias("depth"), *[
                (F.col(f"{p}{d}") / users).alias(n)
                for p, n in (("c", "itemcf_recall"), ("s", "semantic_recall"), ("u", "union_recall"))
            ]) for d in depths
        ])
        long = recalls.select(F.explode(cells).alias("c")).select("c.*")
        tables.append(long.join(ndcg, "setting").select(
            "depth", F.lit(cap).alias("history_cap"), "itemcf_recall", "semantic_recall", "union_recall", "ndcg_at_10"
        ))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    best = Window.orderBy(
        order_score("ndcg_at_10").desc(), order_score("union_recall").desc(), F.col("depth"), F.col("history_cap")
    )  # grid size rows
    return table.withColumn("selected", F.row_number().over(best) == 1)


# fixed values: simpler methods win ties
METHOD_PRIORITY = {"itemcf": 0, "rrf": 1, "percentile_linear": 2, "lambdamart": 3}
MARGIN = 1e-12


def ranker_ablation(
    itemcf: DataFrame, semantic: DataFrame, targets: DataFrame, rrf_ks: Sequence[int] = (10, 30, 60, 100), weight_step: float = 0.1
) -> DataFrame:
    """NDCG@10 and recall@10 of ItemCF, min-max 0.7/0.3, RRF and percentile blends.

    ``selected`` marks the best selectable method (min-max is for the report
    only); ``unlocks`` says whether it beats ItemCF.
    """
    rows = candidate_union(itemcf=itemcf, semantic=semantic)
    for route in ("itemcf", "semantic"):
        rows = route_values(rows, route, tuple(rrf_ks))
    units = round(1 / weight_step)
    scores: dict[str, Column] = {"itemcf|": F.when(F.col("in_itemcf"), F.col("itemcf_score"))}
    scores["minmax_linear|0.7"] = 0.7 * F.col("itemcf_minmax") + 0.3 * F.col("semantic_minmax")
    for k in rrf_ks:
        scores[f"rrf|{k}"] = F.col(f"itemcf_rrf{k}") + F.col(f"semantic_rrf{k}")
    for a in range(units, -1, -1):
        left, right = round(a * weight_step, 10), round((units - a) * weight_step, 10)
        scores[f"percentile_linear|{left}"] = F.lit(left) * F.col("itemcf_percentile") + F.lit(right) * F.col("semantic_percentile")
    safe = {f"m{i}": c for i, c in enumerate(scores.values())}
    table = rank_summary(target_ranks(rows, targets, safe), targets.count(), list(safe))
    labels = F.create_map(*[F.lit(v) for pair in zip(safe, scores) for v in pair])
    parts = F.split(F.element_at(labels, F.col("setting")), r"\|")
    named = table.select(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("parameter"), "ndcg_at_10", "recall_at_10")
    priority = F.element_at(F.create_map(*[F.lit(v) for kv in METHOD_PRIORITY.items() for v in kv]), F.col("kind"))
    ranked = named.withColumn("priority", F.when(F.col("kind").isin(*METHOD_PRIORITY), priority))
    best = Window.orderBy(
        F.col("priority").isNull(), order_score("ndcg_at_10").desc(), order_score("recall_at_10").desc(), F.col("priority"),
        F.col("parameter").desc(),
    )  # grid size rows
    base = F.max(F.when(F.col("kind") == "itemcf", F.col("ndcg_at_10"))).over(Window.partitionBy())
    return ranked.withColumn("selected", F.row_number().over(best) == 1).withColumn(
        "unlocks", F.col("selected") & (F.col("kind") != "itemcf") & (F.col("ndcg_at_10") - base > MARGIN)
    ).drop("priority")


def recall_sweep(itemcf: DataFrame, variants: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """Target recall of each semantic variant, of ItemCF, and of their union.

    ``variants`` maps a name to its route, already cut at the variant's depth.
    """
    users = targets.count()
    goal = targets.select("user_id", "item_id")
    base = goal.join(itemcf.select("user_id", "item_id", F.lit(1).alias("cf")), ["user_id", "item_id"], "left")
    for i, route in enumerate(variants.values()):
        base = base.join(route.select("user_id", "item_id", F.lit(1).alias(f"v{i}")), ["user_id", "item_id"], "left")
    share = lambda c: F.count_if(c) / users
    sums = base.agg(
        share(F.col("cf").isNotNull()).alias("cf"),
        *[share(F.col(f"v{i}").isNotNull()).alias(f"v{i}") for i in range(len(variants))],
        *[share(F.col(f"v{i}").isNotNull() | F.col("cf").isNotNull()).alias(f"u{i}") for i in range(len(variants))],
    )
    cells = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"v{i}").alias("semantic_recall"), F.col("cf").alias("itemcf_recall"), F.col(f"u{i}").alias("union_recall"))
        for i, n in enumerate(variants)
    ])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def select_recall_winner(sweep: DataFrame, baseline: str = "baseline-top500", lift: float = 0.05, union_floor: float | None = None) -> DataFrame:
    """Sweep rows with ``winner``: lifts semantic recall enough, and beats the baseline's union recall."""
    everything = Window.partitionBy()
    at_base = lambda c: F.max(F.when(F.col("variant") == baseline, F.col(c))).over(everything)
    floor = at_base("union_recall") if union_floor is None else F.lit(union_floor)
    able = (
        (F.col("variant") != baseline)
        & (order_score("semantic_recall") >= order_score(at_base("semantic_recall") + F.lit(lift)))
        & (F.col("union_recall") > floor)
    )
    best = Window.orderBy(F.col("able").desc(), order_score("semantic_recall").desc(), order_score("union_recall").desc(), F.col("variant"))
    marked = sweep.withColumn("able", able)
    return marked.withColumn("winner", F.col("able") & (F.row_number().over(best) == 1)).drop("able")


def ranker_diagnostics(scored: DataFrame, targets: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """Where targets rank and how their features differ from the negatives.

    ``scored`` holds features plus ``score`` (the learned ranker's). Returns
    ``summary`` (one row) and ``separation`` (one row per feature).
    """
    users = targets.count()
    ranks = target_ranks(scored, targets, {"itemcf": F.col("itemcf_score"), "learned": F.col("score")})
    goal = targets.select("user_id", F.col("item_id").alias("target"))
    flags = scored.join(goal, "user_id").filter(F.col("item_id") == F.col("target")).select("user_id", "in_itemcf", "in_dense")
    present = flags.join(ranks, "user_id")
    per = lambda c, n: (F.coalesce(F.sum(c), F.lit(0.0)) / n)
    totals = present.agg(
        F.count(F.lit(1)).alias("present_users"),
        *[per(c, users).alias(n) for n, c in {
            "union_recall": F.lit(1.0), "itemcf_recall": F.col("in_itemcf"), "dense_recall": F.col("in_dense"),
            "itemcf_hit": _hit(F.col("itemcf")), "learned_hit": _hit(F.col("learned")),
            "itemcf_ndcg": _ndcg(F.col("itemcf")), "learned_ndcg": _ndcg(F.col("learned")),
        }.items()],
        F.avg(_hit(F.col("itemcf"))).alias("itemcf_hit_present"),
        F.avg(_hit(F.col("learned"))).alias("learned_hit_present"),
        F.avg(_ndcg(F.col("itemcf"))).alias("itemcf_ndcg_present"),
        F.avg(_ndcg(F.col("learned"))).alias("learned_ndcg_present"),
        F.lit(1).alias("one"),
    )
    marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    summary = totals
    for name in ("itemcf", "learned"):
        q = nearest_rank(ranks, name, {f"{name}_{m}": p for m, p in marks.items()}).withColumn("one", F.lit(1))
        summary = summary.join(q, "one", "left")
    is_target = F.col("item_id") == F.col("target")
    means = scored.join(goal, "user_id").groupBy("user_id").agg(
        *[F.max(F.when(is_target, F.col(f))).alias(f"t_{f}") for f in features],
        *[F.avg(F.when(~is_target, F.col(f))).alias(f"n_{f}") for f in features],
    )
    deltas = means.agg(*[F.avg(F.col(f"t_{f}") - F.coalesce(F.col(f"n_{f}"), F.lit(0.0))).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("separation")) for f in features])
    return {
        "summary": summary.drop("one").withColumn("users", F.lit(users)),
        "separation": deltas.select(F.explode(cells).alias("c")).select("c.*"),
    }


def latent_diagnostics(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Latent-route recall at several depths, latent-only coverage, and route overlap: one row."""
    users = targets.count()
    goal = targets.select("user_id", F.col("item_id").alias("target"))
    latent = F.when(F.col("in_latent") == 1, F.col("latent_score"))
    ranks = target_ranks(features, targets, {"latent": latent}).select("user_id", F.col("latent").alias("latent_rank"))
    both = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 1))
    either = lambda a, b: F.count_if((F.col(a) == 1) | (F.col(b) == 1))
    is_target = F.col("item_id") == F.col("target")
    per_user = goal.join(features, "user_id", "left").groupBy("user_id").agg(
        F.max(F.when(is_target, F.lit(1))).alias("in_union"),
        *[F.coalesce(F.max(F.when(is_target, F.col(f"in_{r}"))), F.lit(0.0)).alias(r) for r in ("itemcf", "dense", "latent")],
        F.coalesce(both("in_itemcf", "in_latent") / F.nullif(either("in_itemcf", "in_latent"), F.lit(0)), F.lit(0.0)).alias("overlap_i"),
        F.coalesce(both("in_dense", "in_latent") / F.nullif(either("in_dense", "in_latent"), F.lit(0)), F.lit(0.0)).alias("overlap_d"),
    ).join(ranks, "user_id", "left")
    at = lambda k: F.when(F.col("latent_rank") <= k, 1.0).otherwise(0.0)
    present = F.col("latent") == 1
    one = per_user.agg(
        F.count_if(present).alias("latent_present_users"),
        *[(F.sum(at(k)) / users).alias(f"recall_{k}") for k in (10, 50, 100)],
        (F.sum("latent") / users).alias("recall_500"),
        F.coalesce(F.avg(F.when(present, at(10))), F.lit(0.0)).alias("recall_10_present"),
        (F.count("in_union") / users).alias("union_recall"),
        (F.count_if(present & (F.col("itemcf") == 0) & (F.col("dense") == 0)) / users).alias("latent_only_coverage"),
        F.avg("overlap_i").alias("overlap_itemcf_latent"),
        F.avg("overlap_d").alias("overlap_dense_latent"),
        F.lit(1).alias("one"),
    )
    q = nearest_rank(ranks, "latent_rank", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumn("one", F.lit(1))
    return one.join(q, "one", "left").fillna(0.0, ["p25", "p50", "p75"]).drop("one").withColumn("users", F.lit(users))
