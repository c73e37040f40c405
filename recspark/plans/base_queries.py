"""Sources, splits, popularity, ItemCF and single-method evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recspark.operators import itemcf, metrics, popularity, splits
from recspark.plans.context import Inputs, longs, query, rounded
from recspark.plans.oracle import cte, oracle
from recspark.session import scratch_path, stored
from recspark.sources import files

cte("inter", "", """
SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(least(5, ceil(l_quantity / 10)) AS INTEGER) AS rating,
       CAST(epoch(o_orderdate) AS BIGINT) AS ts,
       l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3, l_quantity AS k4, l_extendedprice AS k5
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("items", "", """
SELECT p_partkey AS item_id, p_name AS title, [p_type, p_brand] AS genres,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE 1950 + p_size END AS year,
       p_name || ' ' || p_type || ' ' || p_brand AS text
FROM part""")
cte("users", "", "SELECT c_custkey AS user_id FROM customer")
cte("latest", "inter", """
SELECT * FROM (SELECT user_id, item_id, ts, rating,
    row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) AS rn
  FROM inter WHERE rating >= 4) WHERE rn = 1""")
cte("last3", "latest", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, rating DESC) AS n FROM latest""")
cte("targets", "last3", """
SELECT user_id,
       max(item_id) FILTER (WHERE n = 3) AS ranker_item, max(ts) FILTER (WHERE n = 3) AS r_ts,
       max(rating) FILTER (WHERE n = 3) AS r_rating,
       max(item_id) FILTER (WHERE n = 2) AS validation_item, max(ts) FILTER (WHERE n = 2) AS v_ts,
       max(rating) FILTER (WHERE n = 2) AS v_rating,
       max(item_id) FILTER (WHERE n = 1) AS test_item
FROM last3 GROUP BY user_id HAVING count(*) >= 3""")
cte("rankhist", "inter targets", """
SELECT i.* FROM inter i LEFT JOIN targets t USING (user_id)
WHERE t.user_id IS NULL OR (
  (i.ts < t.r_ts OR (i.ts = t.r_ts AND (i.item_id < t.ranker_item OR (i.item_id = t.ranker_item AND i.rating < t.r_rating))))
  AND i.item_id NOT IN (t.ranker_item, t.validation_item, t.test_item))""")
cte("legal", "inter targets", """
SELECT i.* FROM inter i LEFT JOIN targets t USING (user_id)
WHERE t.user_id IS NULL OR (
  (i.ts < t.v_ts OR (i.ts = t.v_ts AND (i.item_id < t.validation_item OR (i.item_id = t.validation_item AND i.rating < t.v_rating))))
  AND i.item_id NOT IN (t.validation_item, t.test_item))""")
cte("hist", "legal items", "SELECT * FROM legal WHERE rating >= 4 AND item_id IN (SELECT item_id FROM items)")
cte("seen", "hist", "SELECT DISTINCT user_id, item_id FROM hist")
cte("goals", "targets", "SELECT user_id, validation_item AS item_id FROM targets")
cte("pop", "legal", "SELECT item_id, count(*) AS popularity FROM legal WHERE rating >= 4 GROUP BY item_id")
cte("likes", "legal", "SELECT DISTINCT user_id, item_id FROM legal WHERE rating >= 4")
cte("sim", "likes pop", """
SELECT c.src, c.dst, c.n / sqrt(a.popularity * b.popularity) AS score
FROM (SELECT x.item_id AS src, y.item_id AS dst, count(*) AS n
      FROM likes x JOIN likes y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY ALL) c
JOIN pop a ON a.item_id = c.src JOIN pop b ON b.item_id = c.dst""")
cte("neighbours", "seen sim", """
SELECT s.user_id, m.dst AS item_id, sum(m.score) AS score
FROM seen s JOIN sim m ON s.item_id = m.src
WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = s.user_id AND z.item_id = m.dst)
GROUP BY ALL""")
cte("lonely", "users neighbours", "SELECT user_id FROM users WHERE user_id NOT IN (SELECT user_id FROM neighbours)")
cte("cfscores", "neighbours lonely pop seen", """
SELECT user_id, item_id, score FROM neighbours
UNION ALL
SELECT l.user_id, p.item_id, CAST(p.popularity AS DOUBLE)
FROM lonely l CROSS JOIN pop p
WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = l.user_id AND z.item_id = p.item_id)""")
cte("cfrank", "cfscores", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM cfscores""")
cte("recent", "hist", """
SELECT DISTINCT user_id, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC) AS n
  FROM hist) WHERE n <= 10""")


@query("interactions")
def _interactions(x: Inputs):
    return x.inter.select(*longs("user_id", "item_id", "rating", "ts"), F.col("row_key.l_orderkey").alias("order_key"))


oracle("interactions", "inter", """
SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts, k1 AS order_key FROM inter""")


@query("item_text")
def _item_text(x: Inputs):
    return x.items.select("item_id", "title", "text", F.col("year").cast("bigint").alias("year"))


oracle("item_text", "items", "SELECT item_id, title, text, CAST(year AS BIGINT) AS year FROM items")


@query("read_items")
def _read_items(x: Inputs):
    """Write the catalog as ``::`` lines, read it back with the text source."""
    path = scratch_path(x.spark, "items")
    title = F.concat("title", F.coalesce(F.concat(F.lit(" ("), "year", F.lit(")")), F.lit("")))
    x.items.select(
        F.concat_ws("::", F.col("item_id").cast("string"), title, F.array_join("genres", "|")).alias("value")
    ).write.text(path)
    return files.read_items(x.spark, path).select(
        "item_id", "title", F.array_join("genres", ",").alias("genre_names"), F.col("year").cast("bigint").alias("year"), "text"
    )


oracle("read_items", "items", """
SELECT item_id, t AS title, array_to_string(genres, ',') AS genre_names, CAST(year AS BIGINT) AS year,
       t || ' ' || array_to_string(genres, ' ') AS text
FROM (SELECT *, title || coalesce(' (' || year || ')', '') AS t FROM items)""")


@query("read_interactions")
def _read_interactions(x: Inputs):
    path = scratch_path(x.spark, "ratings")
    x.inter.select(
        F.concat_ws("::", *[F.col(c).cast("string") for c in ("user_id", "item_id", "rating", "ts")]).alias("value")
    ).write.text(path)
    return files.read_interactions(x.spark, path).select(*longs("user_id", "item_id", "rating", "ts"))


oracle("read_interactions", "inter", """
SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM inter""")


@query("chronological_train")
def _chronological_train(x: Inputs):
    train, _ = splits.chronological_split(x.inter)
    return train.select(*longs("user_id", "item_id", "rating", "ts"))


cte("lastpos", "inter", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC) AS n,
       count(*) OVER (PARTITION BY user_id) AS total
FROM inter WHERE rating >= 4""")
cte("ctrain", "inter lastpos", """
SELECT user_id, item_id, rating, ts FROM inter WHERE rating < 4
UNION ALL SELECT user_id, item_id, rating, ts FROM lastpos WHERE total < 3 OR n > 2""")
cte("ctargets", "lastpos", """
SELECT user_id, max(item_id) FILTER (WHERE n = 2) AS validation_item, max(item_id) FILTER (WHERE n = 1) AS test_item
FROM lastpos WHERE total >= 3 GROUP BY user_id""")
oracle("chronological_train", "ctrain", """
SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM ctrain""")


@query("chronological_targets")
def _chronological_targets(x: Inputs):
    return splits.chronological_split(x.inter)[1]


oracle("chronological_targets", "ctargets", "SELECT user_id, validation_item, test_item FROM ctargets")


@query("ranking_targets")
def _ranking_targets(x: Inputs):
    return x.targets.select("user_id", "ranker_item", "validation_item", "test_item")


oracle("ranking_targets", "targets", "SELECT user_id, ranker_item, validation_item, test_item FROM targets")


@query("ranker_history")
def _ranker_history(x: Inputs):
    return splits.ranker_history(x.inter, x.targets).select(*longs("user_id", "item_id", "rating", "ts"))


oracle("ranker_history", "rankhist", "SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM rankhist")


@query("legal_train")
def _legal_train(x: Inputs):
    return x.legal.select(*longs("user_id", "item_id", "rating", "ts"))


oracle("legal_train", "legal", "SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM legal")


@query("positive_histories")
def _positive_histories(x: Inputs):
    return splits.positive_histories(x.legal, x.items).select(*longs("user_id", "item_id", "rating", "ts"))


oracle("positive_histories", "hist", "SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM hist")


@query("group_kfold")
def _group_kfold(x: Inputs):
    return splits.group_kfold(x.goals, 3).select("user_id", F.col("fold").cast("bigint").alias("fold"))


oracle("group_kfold", "goals", """
SELECT user_id, CAST((row_number() OVER (ORDER BY user_id DESC) - 1) % 3 AS BIGINT) AS fold FROM goals""")


@query("restrict_users")
def _restrict_users(x: Inputs):
    """Training rows of the historical cohort: the first 500 eligible users."""
    cohort = splits.first_users(x.goals, 500)
    return splits.restrict_users(x.legal, cohort).select(*longs("user_id", "item_id", "rating", "ts"))


oracle("restrict_users", "legal goals", """
SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating, ts FROM legal
WHERE user_id IN (SELECT user_id FROM goals ORDER BY user_id LIMIT 500)""")


@query("popularity")
def _popularity(x: Inputs):
    top = popularity.popularity_topk(x.legal_positives, x.items, x.users, x.seen, 10)
    return top.select("user_id", "item_id", *longs("rank"), *rounded("score"))


cte("allpop", "items pop", """
SELECT i.item_id, coalesce(p.popularity, 0) AS popularity FROM items i LEFT JOIN pop p USING (item_id)""")
cte("poprank", "users allpop seen", """
SELECT u.user_id, a.item_id, CAST(a.popularity AS DOUBLE) AS score,
       row_number() OVER (PARTITION BY u.user_id ORDER BY a.popularity DESC, a.item_id) AS rank
FROM users u CROSS JOIN allpop a
WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = u.user_id AND z.item_id = a.item_id)""")
oracle("popularity", "poprank", "SELECT user_id, item_id, rank, score FROM poprank WHERE rank <= 10")


@query("itemcf_fit")
def _itemcf_fit(x: Inputs):
    return itemcf.itemcf_fit(x.legal).sim.select("src", "dst", *rounded("score"))


oracle("itemcf_fit", "sim", "SELECT src, dst, round(score, 6) AS score FROM sim")


@query("itemcf_folds")
def _itemcf_folds(x: Inputs):
    """Neighbours and best score of each item, fitted without each of three folds of users."""
    folds = stored(splits.group_kfold(x.goals, 3), "folds")
    best = lambda m: m.sim.groupBy("src").agg(F.count(F.lit(1)).alias("neighbours"), F.max("score").alias("best"))
    parts = [best(m).withColumn("fold", F.lit(n).cast("bigint")) for n, m in enumerate(itemcf.fold_models(x.legal_positives, folds, 3))]
    return reduce(DataFrame.unionByName, parts).select("fold", "src", "neighbours", *rounded("best"))


oracle("itemcf_folds", "goals legal", """
WITH f AS MATERIALIZED (SELECT user_id, (row_number() OVER (ORDER BY user_id DESC) - 1) % 3 AS fold FROM (SELECT DISTINCT user_id FROM goals)),
r AS MATERIALIZED (SELECT l.user_id, l.item_id, h.fold FROM legal l JOIN f USING (user_id) JOIN (SELECT unnest(range(3)) AS fold) h ON h.fold <> f.fold
  WHERE l.rating >= 4),
p AS MATERIALIZED (SELECT fold, item_id, count(*) AS n FROM r GROUP BY ALL),
d AS MATERIALIZED (SELECT DISTINCT fold, user_id, item_id FROM r),
c AS MATERIALIZED (SELECT a.fold, a.item_id AS src, b.item_id AS dst, count(*) AS n FROM d a JOIN d b
  ON a.fold = b.fold AND a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL)
SELECT c.fold, src, count(*) AS neighbours, round(max(c.n / sqrt(p.n * q.n)), 6) AS best
FROM c JOIN p ON p.fold = c.fold AND p.item_id = src JOIN p q ON q.fold = c.fold AND q.item_id = dst GROUP BY c.fold, src""")


@query("itemcf_retrieve")
def _itemcf_retrieve(x: Inputs):
    ranked = itemcf.itemcf_retrieve(x.model, x.seen, x.users, x.items, 100)
    return ranked.select("user_id", "item_id", *longs("rank"), *rounded("score"))


oracle("itemcf_retrieve", "cfrank", """
SELECT user_id, item_id, rank, round(score, 6) AS score FROM cfrank WHERE rank <= 100""")


@query("itemcf_score_many")
def _itemcf_score_many(x: Inputs):
    """Score the most popular unseen items and the validation target of every user."""
    popular = popularity.popularity_topk(x.legal_positives, x.items, x.users, x.seen, 10).select("user_id", "item_id")
    pairs = popular.unionByName(x.goals)
    return itemcf.itemcf_score(x.model, x.seen, pairs).select("user_id", "item_id", *rounded("score"))


oracle("itemcf_score_many", "poprank goals cfscores", """
SELECT p.user_id, p.item_id, round(coalesce(c.score, 0.0), 6) AS score
FROM (SELECT user_id, item_id FROM poprank WHERE rank <= 10 UNION SELECT user_id, item_id FROM goals) p
LEFT JOIN cfscores c USING (user_id, item_id)""")


def direct_ranking(x: Inputs):
    return itemcf.itemcf_direct(x.model, x.seen, x.goals, x.items, 10)


cte("directrank", "goals items seen cfscores", """
SELECT g.user_id, i.item_id,
       row_number() OVER (PARTITION BY g.user_id ORDER BY round(coalesce(c.score, 0.0), 9) DESC, i.item_id) AS rank
FROM goals g CROSS JOIN items i LEFT JOIN cfscores c ON c.user_id = g.user_id AND c.item_id = i.item_id
WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = g.user_id AND z.item_id = i.item_id)""")


def direct_metrics(x: Inputs, ranked):
    """Scored rows with a deterministic latency stand-in: the history size."""
    scored = metrics.score_ranking(ranked, x.goals, x.seen, x.items)
    sizes = x.seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    return scored.join(sizes, "user_id", "left").withColumn("latency_ms", F.coalesce("h", F.lit(0)) / 10).drop("h")


def metric_cte(name: str, ranked: str) -> None:
    cte(name, f"goals {ranked} seen items", f"""
SELECT g.user_id, r.rank AS target_rank,
       CASE WHEN r.rank IS NULL THEN 0.0 ELSE 1.0 END AS recall_at_10,
       coalesce(1 / log2(1.0 + r.rank), 0.0) AS ndcg_at_10,
       coalesce(1.0 / r.rank, 0.0) AS mrr_at_10,
       CASE WHEN EXISTS (SELECT 1 FROM seen z WHERE z.user_id = g.user_id AND z.item_id = g.item_id) THEN 0.0 ELSE 1.0 END AS candidate_recall,
       NOT EXISTS (SELECT 1 FROM {ranked} q JOIN seen z ON z.user_id = q.user_id AND z.item_id = q.item_id
                   WHERE q.user_id = g.user_id AND q.rank <= 10) AS constraint_satisfied,
       coalesce((SELECT count(*) FROM seen z WHERE z.user_id = g.user_id), 0) / 10.0 AS latency_ms
FROM goals g LEFT JOIN {ranked} r ON r.user_id = g.user_id AND r.item_id = g.item_id AND r.rank <= 10""")


metric_cte("directmetrics", "directrank")
metric_cte("popmetrics", "poprank")


@query("score_ranking")
def _score_ranking(x: Inputs):
    return direct_metrics(x, direct_ranking(x)).select(
        "user_id", *longs("target_rank"), *rounded("recall_at_10", "ndcg_at_10", "mrr_at_10", "candidate_recall"),
        "constraint_satisfied",
    )


oracle("score_ranking", "directmetrics", """
SELECT user_id, target_rank, CAST(recall_at_10 AS DOUBLE) AS recall_at_10, round(ndcg_at_10, 6) AS ndcg_at_10,
       round(mrr_at_10, 6) AS mrr_at_10, CAST(candidate_recall AS DOUBLE) AS candidate_recall, constraint_satisfied
FROM directmetrics""")


def two_methods(x: Inputs):
    """Per-user metrics and top-10 lists of ItemCF and popularity."""
    direct = direct_ranking(x)
    popular = popularity.popularity_topk(x.legal_positives, x.items, x.goals, x.seen, 10)
    name = lambda df, m: df.withColumn("method", F.lit(m))
    rows = name(direct_metrics(x, direct), "itemcf_direct").unionByName(name(direct_metrics(x, popular), "popularity"))
    ranked = name(direct.select("user_id", "item_id", "rank"), "itemcf_direct").unionByName(
        name(popular.select("user_id", "item_id", "rank"), "popularity")
    )
    return rows, ranked


cte("bothmetrics", "directmetrics popmetrics", """
SELECT 'itemcf_direct' AS method, * FROM directmetrics UNION ALL SELECT 'popularity' AS method, * FROM popmetrics""")
cte("bothranked", "directrank poprank goals", """
SELECT 'itemcf_direct' AS method, user_id, item_id, rank FROM directrank WHERE rank <= 10
UNION ALL SELECT 'popularity', user_id, item_id, rank FROM poprank WHERE rank <= 10 AND user_id IN (SELECT user_id FROM goals)""")


@query("method_aggregates")
def _method_aggregates(x: Inputs):
    rows, ranked = two_methods(x)
    out = metrics.method_aggregates(rows, ranked, x.items.count())
    return out.select("method", *longs("users"), *rounded(
        "recall_at_10", "ndcg_at_10", "mrr_at_10", "candidate_recall", "constraint_rate", "coverage", "latency_p50", "latency_p95"
    ))


oracle("method_aggregates", "bothmetrics bothranked items", """
SELECT m.method, count(*) AS users, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(ndcg_at_10), 6) AS ndcg_at_10,
       round(avg(mrr_at_10), 6) AS mrr_at_10, round(avg(candidate_recall), 6) AS candidate_recall,
       round(avg(CAST(constraint_satisfied AS DOUBLE)), 6) AS constraint_rate,
       round((SELECT count(DISTINCT item_id) FROM bothranked r WHERE r.method = m.method)
             / CAST((SELECT count(*) FROM items) AS DOUBLE), 6) AS coverage,
       list_sort(list(latency_ms))[least(count(*) - 1, CAST(floor(0.5 * count(*)) AS BIGINT)) + 1] AS latency_p50,
       list_sort(list(latency_ms))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT)) + 1] AS latency_p95
FROM bothmetrics m GROUP BY m.method""")


@query("recent_itemcf")
def _recent_itemcf(x: Inputs):
    """Score each user's top ItemCF candidates again with the last ten history rows."""
    candidates = itemcf.itemcf_retrieve(x.model, x.seen, x.users, x.items, 100)
    return itemcf.recent_itemcf(x.model, x.history, candidates).select("user_id", "item_id", *rounded("score"))


cte("recentneighbours", "recent sim", """
SELECT s.user_id, m.dst AS item_id, sum(m.score) AS score FROM recent s JOIN sim m ON s.item_id = m.src
WHERE NOT EXISTS (SELECT 1 FROM recent z WHERE z.user_id = s.user_id AND z.item_id = m.dst) GROUP BY ALL""")
cte("recentscores", "recentneighbours users pop recent", """
SELECT user_id, item_id, score FROM recentneighbours
UNION ALL
SELECT u.user_id, p.item_id, CAST(p.popularity AS DOUBLE) FROM users u CROSS JOIN pop p
WHERE u.user_id NOT IN (SELECT user_id FROM recentneighbours)
  AND NOT EXISTS (SELECT 1 FROM recent z WHERE z.user_id = u.user_id AND z.item_id = p.item_id)""")
oracle("recent_itemcf", "cfrank recentscores", """
SELECT c.user_id, c.item_id, round(coalesce(r.score, 0.0), 6) AS score
FROM cfrank c LEFT JOIN recentscores r USING (user_id, item_id) WHERE c.rank <= 100""")
