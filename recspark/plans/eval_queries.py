"""Metrics, episodes, sweeps, diagnostics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import ablation, episodes, filters, fusion, gates, itemcf, metrics, state, text
from recspark.plans.base_queries import direct_metrics, metric_cte, two_methods
from recspark.plans.context import Inputs, longs, query, rounded
from recspark.plans.oracle import cte, oracle
from recspark.plans.route_queries import BASELINE, MINMAX, TITLES, TITLES_GENRES_YEAR, Routes, feature_table, profile_cte, semantic_cte
from recspark.session import scratch_path, stored
from recspark.sources import files, testdata

REQUIRED = ("itemcf_retrieve",)


def fused_top(r: Routes, k: int = 10):
    return fusion.fuse("minmax_linear", r.itemcf(), r.semantic(), r.x.items, r.states, k=k)


@query("topk_metrics")
def _topk_metrics(x: Inputs):
    """Fused top 10 against both held-out items of every user."""
    relevant = x.targets.select("user_id", F.explode(F.array("validation_item", "test_item")).alias("item_id"))
    out = metrics.topk_metrics(fused_top(Routes(x)), relevant, 10)
    return out.select("user_id", *rounded("recall", "hit_rate", "ndcg"))


cte("fusedtop", "fused_minmax", "SELECT * FROM fused_minmax WHERE rank <= 10")
oracle("topk_metrics", "targets fusedtop", """
SELECT t.user_id, count(f.rank) / 2.0 AS recall, CASE WHEN count(f.rank) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate,
       round(coalesce(sum(1 / log2(1.0 + f.rank)), 0.0) / (1 + 1 / log2(3.0)), 6) AS ndcg
FROM (SELECT user_id, validation_item AS item_id FROM targets UNION ALL SELECT user_id, test_item FROM targets) t
LEFT JOIN fusedtop f USING (user_id, item_id) GROUP BY t.user_id""")


def three_methods(x: Inputs):
    rows, _ = two_methods(x)
    fused = direct_metrics(x, fused_top(Routes(x))).withColumn("method", F.lit("fused"))
    return stored(rows.unionByName(fused), "metrics")


metric_cte("fusedmetrics", "fusedtop")
cte("threemetrics", "bothmetrics fusedmetrics", "SELECT * FROM bothmetrics UNION ALL SELECT 'fused', * FROM fusedmetrics")
cte("widemetrics", "threemetrics", """
SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS j, count(*) OVER () AS n FROM (
  SELECT user_id, max(ndcg_at_10) FILTER (WHERE method = 'itemcf_direct') AS cf, max(ndcg_at_10) FILTER (WHERE method = 'popularity') AS pop,
         max(ndcg_at_10) FILTER (WHERE method = 'fused') AS fused FROM threemetrics GROUP BY user_id)""")
cte("bootmeans", "widemetrics", """
SELECT b, avg(v.cf - v.fused) AS cf_fused, avg(v.pop - v.cf) AS pop_cf, avg(v.pop - v.fused) AS pop_fused FROM (
  SELECT t.b, ('0x' || substr(md5(concat_ws('|', 42, t.b, w.j)), 1, 8))::BIGINT % w.n AS j FROM range(1, 2001) t(b) CROSS JOIN widemetrics w) d
JOIN widemetrics v USING (j) GROUP BY b""")
PAIR = """
SELECT '{a}' AS left_method, '{b}' AS right_method, round((SELECT avg({e}) FROM widemetrics), 6) AS mean_delta,
       round(quantile_cont({c}, 0.025), 6) AS lower, round(quantile_cont({c}, 0.975), 6) AS upper,
       (SELECT count(*) FROM widemetrics) AS users FROM bootmeans"""
PAIRS = [
    PAIR.format(a="fused", b="itemcf_direct", c="cf_fused", e="cf - fused"),
    PAIR.format(a="itemcf_direct", b="popularity", c="pop_cf", e="pop - cf"),
    PAIR.format(a="fused", b="popularity", c="pop_fused", e="pop - fused"),
]


@query("paired_bootstrap")
def _paired_bootstrap(x: Inputs):
    out = metrics.paired_bootstrap(stored(two_methods(x)[0], "metrics"), "itemcf_direct", "popularity")
    return out.select("left_method", "right_method", *rounded("mean_delta", "lower", "upper"), *longs("users"))


cte("paironly", "bothmetrics", """
SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS j, count(*) OVER () AS n FROM (
  SELECT user_id, max(ndcg_at_10) FILTER (WHERE method = 'popularity') - max(ndcg_at_10) FILTER (WHERE method = 'itemcf_direct') AS d
  FROM bothmetrics GROUP BY user_id)""")
oracle("paired_bootstrap", "paironly", """
SELECT 'itemcf_direct' AS left_method, 'popularity' AS right_method, round((SELECT avg(d) FROM paironly), 6) AS mean_delta,
       round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, (SELECT count(*) FROM paironly) AS users
FROM (SELECT b, avg(v.d) AS m FROM (
  SELECT t.b, ('0x' || substr(md5(concat_ws('|', 42, t.b, w.j)), 1, 8))::BIGINT % w.n AS j FROM range(1, 2001) t(b) CROSS JOIN paironly w) d
  JOIN paironly v USING (j) GROUP BY b)""")


@query("pairwise_summary")
def _pairwise_summary(x: Inputs):
    out = metrics.pairwise_summary(three_methods(x), ["itemcf_direct", "popularity", "fused"])
    return out.select("left_method", "right_method", *rounded("mean_delta", "lower", "upper"), *longs("users"))


oracle("pairwise_summary", "bootmeans widemetrics", " UNION ALL ".join(PAIRS))


@query("user_metrics_roundtrip")
def _user_metrics_roundtrip(x: Inputs):
    rows = two_methods(x)[0].withColumn("cohort", F.lit("validation"))
    path = scratch_path(x.spark, "evidence")
    files.write_user_metrics(rows, path)
    back = x.spark.read.parquet(path)
    return back.select("cohort", "method", "user_id", *rounded("recall_at_10", "ndcg_at_10", "mrr_at_10"), "constraint_satisfied")


oracle("user_metrics_roundtrip", "bothmetrics", """
SELECT 'validation' AS cohort, method, user_id, CAST(recall_at_10 AS DOUBLE) AS recall_at_10, round(ndcg_at_10, 6) AS ndcg_at_10,
       round(mrr_at_10, 6) AS mrr_at_10, constraint_satisfied FROM bothmetrics""")


# --- episodes -----------------------------------------------------------------


def turn_table(x: Inputs):
    """Conversation turns as step logs: tool by role, success and latency from the text length."""
    size = F.length("text")
    tool = F.when(F.col("role") == "system", "hard_filter").when(F.col("role") == "user", "itemcf_retrieve").otherwise("rerank")
    return x.table("conversations").select(
        F.col("conv_id").alias("case_id"),
        F.col("turn").alias("position"),
        tool.alias("tool"),
        (size % 7 != 0).alias("success"),
        size.cast("double").alias("latency_ms"),
        size.cast("bigint").alias("size"),
    )


cte("steps", "", """
SELECT conv_id AS case_id, turn AS position,
       CASE role WHEN 'system' THEN 'hard_filter' WHEN 'user' THEN 'itemcf_retrieve' ELSE 'rerank' END AS tool,
       length(text) % 7 <> 0 AS success, CAST(length(text) AS DOUBLE) AS latency_ms, CAST(length(text) AS BIGINT) AS size
FROM conversations""")


@query("trace_compliance")
def _trace_compliance(x: Inputs):
    return episodes.trace_compliance(turn_table(x), REQUIRED)


cte("compliance", "steps", """
SELECT case_id, coalesce(f < r AND r < k, false) AS compliant FROM (
  SELECT case_id, min(position) FILTER (WHERE tool = 'hard_filter' AND success) AS f,
         min(position) FILTER (WHERE tool = 'itemcf_retrieve' AND success) AS r,
         min(position) FILTER (WHERE tool = 'rerank' AND success) AS k FROM steps GROUP BY case_id)""")
oracle("trace_compliance", "compliance", "SELECT case_id, compliant FROM compliance")


@query("plan_valid")
def _plan_valid(x: Inputs):
    return episodes.plan_valid(turn_table(x), REQUIRED)


cte("planvalid", "steps", """
SELECT case_id, reason = '' AS plan_valid, reason FROM (
  SELECT case_id, CASE WHEN count(*) > 12 THEN 'plan is longer than allowed'
    WHEN count(*) FILTER (WHERE tool = 'rerank') = 0 THEN 'nothing ranks the candidates'
    WHEN count(*) FILTER (WHERE tool = 'itemcf_retrieve') = 0 THEN 'no step retrieves candidates'
    WHEN coalesce(min(position) FILTER (WHERE tool = 'hard_filter') > min(position) FILTER (WHERE tool = 'itemcf_retrieve'), true)
      THEN 'filtering comes after retrieval'
    WHEN min(position) FILTER (WHERE tool = 'rerank') < max(position) FILTER (WHERE tool = 'itemcf_retrieve') THEN 'ranking comes before retrieval ends'
    ELSE '' END AS reason FROM steps GROUP BY case_id)""")
oracle("plan_valid", "planvalid", "SELECT case_id, plan_valid, reason FROM planvalid")


def rolled(x: Inputs):
    turns = turn_table(x).select(
        "case_id", F.col("position").alias("turn"), "latency_ms", F.lit(1).cast("bigint").alias("model_calls"),
        F.col("size").alias("prompt_tokens"), (F.col("size") % 10).alias("completion_tokens"), (~F.col("success")).alias("failed"),
        (F.col("size") % 11 == 0).alias("fallback_used"), (F.col("size") % 13 != 0).alias("plan_valid"), F.col("size").alias("answer"),
    )
    return episodes.episode_rollup(turns)


@query("episode_rollup")
def _episode_rollup(x: Inputs):
    return rolled(x).select(
        "case_id", *longs("turns", "model_calls", "prompt_tokens", "completion_tokens", "answer"), "latency_ms", "failed", "fallback_used", "plan_valid"
    )


cte("rolled", "steps", """
SELECT case_id, count(*) AS turns, count(*) AS model_calls, CAST(sum(size) AS BIGINT) AS prompt_tokens,
       CAST(sum(size % 10) AS BIGINT) AS completion_tokens, arg_max(size, position) AS answer, sum(latency_ms) AS latency_ms,
       bool_or(NOT success) AS failed, bool_or(size % 11 = 0) AS fallback_used, bool_and(size % 13 <> 0) AS plan_valid
FROM steps GROUP BY case_id""")
oracle("episode_rollup", "rolled", "SELECT * FROM rolled")


def logged_turns(x: Inputs):
    """Turns with what an episode keeps of them: its step, an error if that failed, state and items."""
    return turn_table(x).select(
        "case_id", F.col("position").alias("turn"), "latency_ms", F.lit(1).cast("bigint").alias("model_calls"),
        F.col("size").alias("prompt_tokens"), (F.col("size") % 10).alias("completion_tokens"), (~F.col("success")).alias("failed"),
        F.lit(False).alias("fallback_used"), F.lit(True).alias("plan_valid"),
        F.array(F.struct("tool", "success", "size")).alias("traces"),
        F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.col("tool"), F.lit(" failed")))).alias("errors"),
        F.struct(F.col("size").alias("requested_count"), F.array("tool").alias("required_genres")).alias("state"),
        F.array("size", F.col("size") % 10).alias("items"),
    )


@query("episode_records")
def _episode_records(x: Inputs):
    """Steps and errors counted, state and items of the last turn."""
    out = episodes.episode_rollup(logged_turns(x))
    return out.select(
        "case_id", *longs("turns", "steps", "error_count"), F.col("state.requested_count").alias("requested_count"),
        F.element_at("state.required_genres", 1).alias("required"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"),
    )


oracle("episode_records", "steps", """
SELECT case_id, count(*) AS turns, count(*) AS steps, count(*) FILTER (WHERE NOT success) AS error_count,
       arg_max(size, position) AS requested_count, arg_max(tool, position) AS required,
       arg_max(size || ',' || (size % 10), position) AS items
FROM steps GROUP BY case_id""")


@query("episode_steps")
def _episode_steps(x: Inputs):
    """The errors of all turns as rows."""
    steps = episodes.episode_steps(logged_turns(x), log="errors")
    return steps.select("case_id", *longs("turn", "position"), F.col("entry").alias("error"))


oracle("episode_steps", "steps", """
SELECT case_id, CAST(position AS BIGINT) AS turn, CAST(0 AS BIGINT) AS position, tool || ' failed' AS error FROM steps WHERE NOT success""")


@query("episodes_roundtrip")
def _episodes_roundtrip(x: Inputs):
    """Episodes written as nested JSON lines and read back."""
    nested = rolled(x).select("case_id", F.struct("latency_ms", "turns", "plan_valid").alias("result"))
    path = scratch_path(x.spark, "episodes")
    files.write_episodes(nested, path)
    back = x.spark.read.schema("case_id BIGINT, result STRUCT<latency_ms: DOUBLE, turns: BIGINT, plan_valid: BOOLEAN>").json(path)
    return back.select("case_id", "result.latency_ms", "result.turns", "result.plan_valid")


oracle("episodes_roundtrip", "rolled", "SELECT case_id, latency_ms, turns, plan_valid FROM rolled")


def diagnostics(x: Inputs, r: Routes, top):
    eligible = filters.hard_filter(x.goals, x.items, x.constraints, x.seen)
    return episodes.candidate_diagnostics(x.goals, eligible, r.itemcf(), r.semantic(), top)


@query("candidate_diagnostics")
def _candidate_diagnostics(x: Inputs):
    r = Routes(x)
    return diagnostics(x, r, fused_top(r)).select(
        "user_id", "item_id", "eligible", *longs("itemcf_rank", "semantic_rank"), "union_member", *longs("final_rank")
    )


cte("diag", "goals cfeval semeval fusedtop allowedcons seen", """
SELECT g.user_id, g.item_id, a.item_id IS NOT NULL AND z.item_id IS NULL AS eligible, c.rank AS itemcf_rank, s.rank AS semantic_rank,
       c.rank IS NOT NULL OR s.rank IS NOT NULL AS union_member, f.rank AS final_rank
FROM goals g LEFT JOIN cfeval c USING (user_id, item_id) LEFT JOIN semeval s USING (user_id, item_id) LEFT JOIN fusedtop f USING (user_id, item_id)
LEFT JOIN allowedcons a USING (user_id, item_id) LEFT JOIN seen z USING (user_id, item_id)""")
oracle("candidate_diagnostics", "diag", "SELECT * FROM diag")


@query("episode_metrics")
def _episode_metrics(x: Inputs):
    """Conversations joined with the evaluated user of the same number.

    Preferences are retained if the user's folded session still holds every value it was
    ever given; a label is eligible if the target satisfies the user's constraints.
    """
    r = Routes(x)
    top = stored(fused_top(r), "fused")
    logs = rolled(x).withColumnRenamed("case_id", "user_id").join(x.goals.select("user_id"), "user_id", "left_semi")
    compliant = episodes.trace_compliance(turn_table(x), REQUIRED).withColumnRenamed("case_id", "user_id")
    patches = testdata.patches(x.spark, x.sf_dir)
    everything = state.fold_preferences(patches.withColumn("replace_soft", F.lit(False)))
    kept = filters.preference_retention(state.fold_preferences(patches), everything).withColumnRenamed("session_id", "user_id")
    fitting = filters.hard_filter(x.goals, x.items, x.constraints).groupBy("user_id").agg(F.lit(True).alias("fits"))
    cases = logs.join(compliant, "user_id").join(kept, "user_id", "left").join(fitting, "user_id", "left").withColumn(
        "label_eligible", F.coalesce("fits", F.lit(False))).drop("fits")
    ids = stored(cases, "cases")
    mine = lambda df: df.join(ids.select("user_id"), "user_id", "left_semi")
    excluded = x.inter.filter("rating < 3").select("user_id", "item_id")
    audit = filters.constraint_audit(mine(top), x.items, x.constraints, excluded)
    traces = mine(turn_table(x).withColumnRenamed("case_id", "user_id"))
    out = episodes.episode_metrics(ids, traces, mine(top), mine(x.goals), mine(diagnostics(x, r, top)), audit)
    whole = ["episodes", "model_calls", "total_tokens"]
    return out.select(*longs(*whole), *rounded(*[c for c in out.columns if c not in whole]))


cte("kept", "folded foldedsoft", """
SELECT w.session_id, bool_and(h.value IS NOT NULL) AS retained
FROM foldedsoft w LEFT JOIN (
  SELECT session_id, field, value FROM folded UNION SELECT session_id, 'disliked_genres', value FROM folded WHERE field = 'excluded_genres') h
USING (session_id, field, value) GROUP BY w.session_id""")
cte("epi", "rolled goals compliance fusedtop diag allowedcons inter kept", """
SELECT r.*, c.compliant, g.item_id AS target, f.rank, k.retained,
  EXISTS (SELECT 1 FROM allowedcons a WHERE a.user_id = g.user_id AND a.item_id = g.item_id) AS label_eligible,
  coalesce((SELECT bool_and(a.item_id IS NOT NULL AND e.item_id IS NULL) FROM fusedtop t
     LEFT JOIN allowedcons a ON a.user_id = t.user_id AND a.item_id = t.item_id
     LEFT JOIN (SELECT DISTINCT user_id, item_id FROM inter WHERE rating < 3) e ON e.user_id = t.user_id AND e.item_id = t.item_id
     WHERE t.user_id = r.case_id), true) AS satisfied,
  (SELECT count(*) FROM fusedtop t WHERE t.user_id = r.case_id AND EXISTS (
     SELECT 1 FROM inter e WHERE e.rating < 3 AND e.user_id = t.user_id AND e.item_id = t.item_id)) AS hits,
  (SELECT count(*) FROM fusedtop t WHERE t.user_id = r.case_id) AS recs
FROM rolled r JOIN goals g ON g.user_id = r.case_id JOIN compliance c USING (case_id) LEFT JOIN kept k ON k.session_id = r.case_id
LEFT JOIN fusedtop f ON f.user_id = r.case_id AND f.item_id = g.item_id""")
oracle("episode_metrics", "epi steps diag", """
SELECT count(*) AS episodes, CAST(sum(model_calls) AS BIGINT) AS model_calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
  round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / log2(1.0 + rank), 0.0)), 6) AS ndcg, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate,
  round(avg(plan_valid::INT), 6) AS plan_valid_rate, round(avg(failed::INT), 6) AS episode_failure_rate, round(avg(fallback_used::INT), 6) AS fallback_rate,
  round(avg(satisfied::INT), 6) AS constraint_satisfaction_rate, round(sum(hits) / CAST(sum(recs) AS DOUBLE), 6) AS excluded_item_violation_rate,
  round(coalesce(avg(retained::INT), 0.0), 6) AS preference_retention_rate, round(avg(label_eligible::INT), 6) AS relevance_label_eligibility_rate, round(avg(compliant::INT), 6) AS compliance_rate,
  (SELECT round(avg(success::INT), 6) FROM steps WHERE case_id IN (SELECT case_id FROM epi)) AS tool_success_rate,
  (SELECT round(avg(eligible::INT), 6) FROM diag WHERE user_id IN (SELECT case_id FROM epi)) AS final_state_target_eligibility_rate,
  (SELECT round(avg((itemcf_rank IS NOT NULL)::INT), 6) FROM diag WHERE user_id IN (SELECT case_id FROM epi)) AS itemcf_candidate_recall,
  (SELECT round(avg((semantic_rank IS NOT NULL)::INT), 6) FROM diag WHERE user_id IN (SELECT case_id FROM epi)) AS semantic_candidate_recall,
  (SELECT round(avg(union_member::INT), 6) FROM diag WHERE user_id IN (SELECT case_id FROM epi)) AS union_candidate_recall,
  round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms
FROM epi""")


# --- sweeps -------------------------------------------------------------------

cte("evalunion", "cfeval semeval", """
SELECT user_id, item_id, max(cs) AS cs, max(cr) AS cr, max(ss) AS ss, max(sr) AS sr FROM (
  SELECT user_id, item_id, score AS cs, rank AS cr, NULL::DOUBLE AS ss, NULL::BIGINT AS sr FROM cfeval
  UNION ALL SELECT user_id, item_id, NULL, NULL, score, rank FROM semeval) GROUP BY user_id, item_id""")
OVER_USER = lambda s: "CASE WHEN " + s + " IS NULL THEN 0.0 ELSE " + MINMAX.format(s=s).replace("OVER w", "OVER (PARTITION BY user_id)") + " END"
PERCENT = lambda s: f"CASE WHEN {s} IS NULL THEN 0.0 ELSE 1 - percent_rank() OVER (PARTITION BY user_id, {s} IS NULL ORDER BY round({s}, 9) DESC) END"
cte("normal", "evalunion", f"""
SELECT *, {OVER_USER('cs')} AS cm, {OVER_USER('ss')} AS sm, {PERCENT('cs')} AS cp, {PERCENT('ss')} AS sp FROM evalunion""")


@query("tune_weights")
def _tune_weights(x: Inputs):
    r = Routes(x)
    cf, sem = r.itemcf(), r.semantic()
    pairs = cf.select("user_id", "item_id").unionByName(sem.select("user_id", "item_id")).distinct()
    liked = pairs.join(x.items.select("item_id", "genres"), "item_id").join(r.states.select("user_id", "liked_genres"), "user_id")
    preference = liked.select("user_id", "item_id", F.arrays_overlap("genres", "liked_genres").cast("double").alias("preference"))
    out = ablation.tune_weights(cf, sem, preference, x.goals)
    return out.select(*longs("w1", "w2", "w3"), *rounded("ndcg_at_10"), "selected")


oracle("tune_weights", "normal items likedgenres goals", """
WITH p AS MATERIALIZED (SELECT n.user_id, n.item_id, cm, sm, list_has_any(i.genres, l.liked_genres)::INT AS pref
  FROM normal n JOIN items i USING (item_id) JOIN likedgenres l USING (user_id)),
grid AS (SELECT a.r AS w1, b.r AS w2, 10 - a.r - b.r AS w3 FROM range(11) a(r), range(11) b(r) WHERE a.r + b.r <= 10),
t AS MATERIALIZED (SELECT p.* FROM p JOIN goals g USING (user_id, item_id)),
k AS (SELECT w1, w2, w3, t.user_id, 1 + count(*) FILTER (WHERE round(w1 * 0.1 * p.cm + w2 * 0.1 * p.sm + w3 * 0.1 * p.pref, 9) > round(w1 * 0.1 * t.cm + w2 * 0.1 * t.sm + w3 * 0.1 * t.pref, 9)
    OR (round(w1 * 0.1 * p.cm + w2 * 0.1 * p.sm + w3 * 0.1 * p.pref, 9) = round(w1 * 0.1 * t.cm + w2 * 0.1 * t.sm + w3 * 0.1 * t.pref, 9) AND p.item_id < t.item_id)) AS rank
  FROM t JOIN p ON p.user_id = t.user_id CROSS JOIN grid GROUP BY ALL),
s AS (SELECT w1, w2, w3, sum(CASE WHEN rank <= 10 THEN 1 / log2(1.0 + rank) ELSE 0.0 END) / (SELECT count(*) FROM goals) AS ndcg FROM k GROUP BY ALL)
SELECT w1, w2, w3, round(ndcg, 6) AS ndcg_at_10, row_number() OVER (ORDER BY round(ndcg, 9) DESC, w2 DESC, w1 DESC) = 1 AS selected FROM s""")


@query("ranker_ablation")
def _ranker_ablation(x: Inputs):
    r = Routes(x)
    out = ablation.ranker_ablation(r.itemcf(), r.semantic(), x.goals)
    return out.select("kind", "parameter", *rounded("ndcg_at_10", "recall_at_10"), "selected", "unlocks")


oracle("ranker_ablation", "normal goals", """
WITH grid AS (SELECT * FROM (VALUES ('itemcf', '', 0.0), ('minmax_linear', '0.7', 0.7), ('rrf', '10', 10), ('rrf', '30', 30), ('rrf', '60', 60), ('rrf', '100', 100)) v(kind, parameter, p)
  UNION ALL SELECT 'percentile_linear', CAST(CAST(r / 10.0 AS DECIMAL(3, 1)) AS VARCHAR), r / 10.0 FROM range(11) t(r)),
s AS MATERIALIZED (SELECT kind, parameter, user_id, item_id, CASE kind WHEN 'itemcf' THEN cs WHEN 'minmax_linear' THEN 0.7 * cm + 0.3 * sm
    WHEN 'rrf' THEN coalesce(1.0 / (p + cr), 0.0) + coalesce(1.0 / (p + sr), 0.0) ELSE p * cp + (1 - p) * sp END AS score
  FROM normal CROSS JOIN grid),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, parameter, user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s WHERE score IS NOT NULL) JOIN goals USING (user_id, item_id)),
m AS (SELECT g.kind, g.parameter, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(1.0 + rank) END), 0.0) / (SELECT count(*) FROM goals) AS ndcg,
    count(*) FILTER (WHERE rank <= 10) / CAST((SELECT count(*) FROM goals) AS DOUBLE) AS recall
  FROM grid g LEFT JOIN k USING (kind, parameter) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY kind = 'minmax_linear', round(ndcg, 9) DESC, round(recall, 9) DESC,
    CASE kind WHEN 'itemcf' THEN 0 WHEN 'rrf' THEN 1 ELSE 2 END, parameter DESC) = 1 AS selected FROM m)
SELECT kind, parameter, round(ndcg, 6) AS ndcg_at_10, round(recall, 6) AS recall_at_10, selected,
       selected AND kind <> 'itemcf' AND ndcg - (SELECT ndcg FROM m WHERE kind = 'itemcf') > 1e-12 AS unlocks FROM o""")

DEPTHS, CAPS = (100, 200, 500), (10, 20, 50)
profile_cte("profile10", 10, *BASELINE)
profile_cte("profile50", 50, *BASELINE)
profile_cte("profile100", 100, *BASELINE)
for _cap in (10, 50, 100):
    semantic_cte(f"semrank{_cap}", f"profile{_cap}")
semantic_cte("semranktitles", "profiletitles")
semantic_cte("semranktgy", "profiletgy")


@query("retrieval_ablation")
def _retrieval_ablation(x: Inputs):
    r = Routes(x, max(DEPTHS))
    out = ablation.retrieval_ablation(r.itemcf(), {c: r.semantic(c) for c in CAPS}, x.goals, DEPTHS)
    return out.select(*longs("depth", "history_cap"), *rounded("itemcf_recall", "semantic_recall", "union_recall", "ndcg_at_10"), "selected")


def _ablation_sql() -> str:
    parts = []
    for cap in CAPS:
        source = "semrank" if cap == 20 else f"semrank{cap}"
        for d in DEPTHS:
            parts.append(f"""
SELECT {d} AS depth, {cap} AS history_cap, count(*) FILTER (WHERE hit AND cs IS NOT NULL) AS c, count(*) FILTER (WHERE hit AND ss IS NOT NULL) AS s,
       count(*) FILTER (WHERE hit) AS u, coalesce(sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(1.0 + rank) END), 0.0) AS n
FROM (SELECT f.*, g.item_id IS NOT NULL AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(0.7 * cm + 0.3 * sm, 9) DESC, item_id) AS rank FROM (
    SELECT *, {OVER_USER('cs')} AS cm, {OVER_USER('ss')} AS sm FROM (
      SELECT user_id, item_id, max(cs) AS cs, max(ss) AS ss FROM (
        SELECT user_id, item_id, score AS cs, NULL::DOUBLE AS ss FROM cfrank WHERE rank <= {d} AND user_id IN (SELECT user_id FROM goals)
        UNION ALL SELECT user_id, item_id, NULL, score FROM {source} WHERE rank <= {d}) GROUP BY user_id, item_id))) f
  LEFT JOIN goals g USING (user_id, item_id))""")
    return f"""
SELECT CAST(depth AS BIGINT) AS depth, CAST(history_cap AS BIGINT) AS history_cap, round(c / n0, 6) AS itemcf_recall, round(s / n0, 6) AS semantic_recall,
       round(u / n0, 6) AS union_recall, round(n / n0, 6) AS ndcg_at_10,
       row_number() OVER (ORDER BY round(n / n0, 9) DESC, round(u / n0, 9) DESC, depth, history_cap) = 1 AS selected
FROM ({' UNION ALL '.join(parts)}) CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n0 FROM goals)"""


oracle("retrieval_ablation", "cfrank goals semrank10 semrank semrank50", _ablation_sql())

# fixed values: sweep variants as (depth, history cap, query style)
VARIANTS = {
    "baseline-top500": (500, 50, "baseline"),
    "top250": (250, 50, "baseline"),
    "top750": (750, 50, "baseline"),
    "top1000": (1000, 50, "baseline"),
    "top1500": (1500, 50, "baseline"),
    "history20": (500, 20, "baseline"),
    "history100": (500, 100, "baseline"),
    "titles-only": (500, 50, "titles-only"),
    "titles-genres-year": (500, 50, "titles-genres-year"),
}


@query("recall_sweep")
def _recall_sweep(x: Inputs):
    """All sweep variants; variants that differ only in depth share one retrieval."""
    deepest = max(d for d, _, _ in VARIANTS.values())
    r = Routes(x, deepest)
    vectors, idf = text.tfidf_fit(x.items)
    found = {}
    for depth, cap, style in VARIANTS.values():
        if (cap, style) not in found:
            need = max(d for d, c, s in VARIANTS.values() if (c, s) == (cap, style))
            profiles = text.semantic_profile(r.states, x.seen, x.items, cap, style)
            users = profiles.join(x.goals.select("user_id"), "user_id", "left_semi")
            ranked = text.tfidf_retrieve(vectors, idf, users, need, x.seen)
            found[cap, style] = stored(ranked.join(x.goals, ["user_id", "item_id"], "left_semi"), "sweep")
    routes = {n: found[c, s].filter(F.col("rank") <= d) for n, (d, c, s) in VARIANTS.items()}
    cf = itemcf.itemcf_retrieve(x.model, x.seen, x.goals, x.items, 500)
    sweep = ablation.select_recall_winner(ablation.recall_sweep(cf, routes, x.goals))
    return sweep.select("variant", *rounded("semantic_recall", "itemcf_recall", "union_recall"), "winner")


def _sweep_sql() -> str:
    source = {(50, "baseline"): "semrank50", (20, "baseline"): "semrank", (100, "baseline"): "semrank100",
              (50, "titles-only"): "semranktitles", (50, "titles-genres-year"): "semranktgy"}
    parts = [
        f"""SELECT '{n}' AS variant, count(s.rank) / n0 AS sr, count(c.rank) / n0 AS cr, count(coalesce(s.rank, c.rank)) / n0 AS ur
FROM goals g LEFT JOIN (SELECT * FROM {source[c, s]} WHERE rank <= {d}) s USING (user_id, item_id)
LEFT JOIN (SELECT * FROM cfrank WHERE rank <= 500) c USING (user_id, item_id) CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n0 FROM goals) GROUP BY n0"""
        for n, (d, c, s) in VARIANTS.items()
    ]
    return f"""
WITH sweep AS MATERIALIZED ({' UNION ALL '.join(parts)}),
able AS (SELECT s.*, s.variant <> b.variant AND round(s.sr, 9) >= round(b.sr + 0.05, 9) AND s.ur > b.ur AS able
  FROM sweep s CROSS JOIN (SELECT * FROM sweep WHERE variant = 'baseline-top500') b)
SELECT variant, round(sr, 6) AS semantic_recall, round(cr, 6) AS itemcf_recall, round(ur, 6) AS union_recall,
       able AND row_number() OVER (ORDER BY able DESC, round(sr, 9) DESC, round(ur, 9) DESC, variant) = 1 AS winner FROM able"""


oracle("recall_sweep", "goals cfrank semrank50 semrank semrank100 semranktitles semranktgy", _sweep_sql())


# --- diagnostics on given scores ---------------------------------------------

SEPARATED = ("itemcf_score", "dense_score", "log1p_popularity", "history_genre_jaccard", "preference_affinity")


def given_scores(x: Inputs):
    """Version 1 features with a fixed linear score in the place of a learned one."""
    features = stored(feature_table(x, "v1"), "features")
    return features.withColumn("score", F.col("itemcf_score") + F.col("dense_score") + 0.1 * F.col("log1p_popularity"))


cte("given", "feat1", "SELECT *, itemcf_score + dense_score + 0.1 * log1p_popularity AS score FROM feat1")
cte("givenrank", "given goals", """
SELECT r.*, g.item_id AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(itemcf_score, 9) DESC, item_id) AS cr,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS lr FROM given) r
JOIN goals g ON g.user_id = r.user_id AND g.item_id = r.item_id""")


@query("ranker_diagnostics")
def _ranker_diagnostics(x: Inputs):
    out = ablation.ranker_diagnostics(given_scores(x), x.goals, SEPARATED)["summary"]
    whole = ["users", "present_users"]
    return out.select(*longs(*whole), *rounded(*[c for c in out.columns if c not in whole]))


AT = lambda c, p: f"list_sort(list({c}))[least(count(*) - 1, CAST(floor({p} * count(*)) AS BIGINT)) + 1]::DOUBLE"
NDCG10 = lambda c: f"CASE WHEN {c} <= 10 THEN 1 / log2(1.0 + {c}) ELSE 0.0 END"
HIT10 = lambda c: f"CASE WHEN {c} <= 10 THEN 1.0 ELSE 0.0 END"
oracle("ranker_diagnostics", "givenrank goals", f"""
SELECT max(n0)::BIGINT AS users, count(*) AS present_users, round(count(*) / max(n0), 6) AS union_recall, round(sum(in_itemcf) / max(n0), 6) AS itemcf_recall,
  round(sum(in_dense) / max(n0), 6) AS dense_recall,
  round(sum({HIT10('cr')}) / max(n0), 6) AS itemcf_hit, round(sum({HIT10('lr')}) / max(n0), 6) AS learned_hit,
  round(sum({NDCG10('cr')}) / max(n0), 6) AS itemcf_ndcg, round(sum({NDCG10('lr')}) / max(n0), 6) AS learned_ndcg,
  round(avg({HIT10('cr')}), 6) AS itemcf_hit_present, round(avg({HIT10('lr')}), 6) AS learned_hit_present,
  round(avg({NDCG10('cr')}), 6) AS itemcf_ndcg_present, round(avg({NDCG10('lr')}), 6) AS learned_ndcg_present,
  {AT('cr', 0.25)} AS itemcf_p25, {AT('cr', 0.5)} AS itemcf_p50, {AT('cr', 0.75)} AS itemcf_p75,
  {AT('lr', 0.25)} AS learned_p25, {AT('lr', 0.5)} AS learned_p50, {AT('lr', 0.75)} AS learned_p75
FROM givenrank CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n0 FROM goals)""")


@query("feature_separation")
def _feature_separation(x: Inputs):
    out = ablation.ranker_diagnostics(given_scores(x), x.goals, SEPARATED)["separation"]
    return out.select("feature", *rounded("separation"))


oracle("feature_separation", "given goals", " UNION ALL ".join(f"""
SELECT '{f}' AS feature, round(avg(t - coalesce(n, 0.0)), 6) AS separation FROM (
  SELECT s.user_id, max(s.{f}) FILTER (WHERE s.item_id = g.item_id) AS t, avg(s.{f}) FILTER (WHERE s.item_id <> g.item_id) AS n
  FROM given s JOIN goals g ON g.user_id = s.user_id GROUP BY s.user_id) WHERE t IS NOT NULL""" for f in SEPARATED))


@query("latent_diagnostics")
def _latent_diagnostics(x: Inputs):
    out = ablation.latent_diagnostics(stored(feature_table(x, "v2"), "features"), x.goals)
    whole = ["users", "latent_present_users"]
    return out.select(*longs(*whole), *rounded(*[c for c in out.columns if c not in whole]))


oracle("latent_diagnostics", "cunion goals", f"""
WITH u AS MATERIALIZED (SELECT g.user_id, bool_or(c.item_id = g.item_id) AS present, max(lr) FILTER (WHERE c.item_id = g.item_id) AS lr,
    max(cr) FILTER (WHERE c.item_id = g.item_id) AS cr, max(dr) FILTER (WHERE c.item_id = g.item_id) AS dr,
    count(*) FILTER (WHERE cr IS NOT NULL AND lr IS NOT NULL) / CAST(count(*) FILTER (WHERE cr IS NOT NULL OR lr IS NOT NULL) AS DOUBLE) AS oi,
    count(*) FILTER (WHERE dr IS NOT NULL AND lr IS NOT NULL) / CAST(count(*) FILTER (WHERE dr IS NOT NULL OR lr IS NOT NULL) AS DOUBLE) AS od
  FROM goals g LEFT JOIN cunion c ON c.user_id = g.user_id GROUP BY g.user_id)
SELECT count(*) AS users, count(lr) AS latent_present_users, round(count(*) FILTER (WHERE lr <= 10) / count(*)::DOUBLE, 6) AS recall_10,
  round(count(*) FILTER (WHERE lr <= 50) / count(*)::DOUBLE, 6) AS recall_50, round(count(*) FILTER (WHERE lr <= 100) / count(*)::DOUBLE, 6) AS recall_100,
  round(count(lr) / count(*)::DOUBLE, 6) AS recall_500, round(coalesce(count(*) FILTER (WHERE lr <= 10) / nullif(count(lr), 0)::DOUBLE, 0.0), 6) AS recall_10_present,
  round(count(*) FILTER (WHERE present) / count(*)::DOUBLE, 6) AS union_recall,
  round(count(*) FILTER (WHERE lr IS NOT NULL AND cr IS NULL AND dr IS NULL) / count(*)::DOUBLE, 6) AS latent_only_coverage,
  round(avg(coalesce(oi, 0.0)), 6) AS overlap_itemcf_latent, round(avg(coalesce(od, 0.0)), 6) AS overlap_dense_latent,
  (SELECT {AT('lr', 0.25)} FROM u WHERE lr IS NOT NULL) AS p25, (SELECT {AT('lr', 0.5)} FROM u WHERE lr IS NOT NULL) AS p50,
  (SELECT {AT('lr', 0.75)} FROM u WHERE lr IS NOT NULL) AS p75 FROM u""")


# --- gates --------------------------------------------------------------------


@query("promotion_gate")
def _promotion_gate(x: Inputs):
    out = gates.promotion_gate(three_methods(x), "popularity", "fused")
    flags = ["mean_improved", "interval_above_zero", "constraints_met", "passed", "reason"]
    return out.select(*rounded(*[c for c in out.columns if c not in flags]), *flags)


cte("gatemeans", "widemetrics", """
SELECT b, avg(v.fused - v.pop) AS m FROM (
  SELECT t.b, ('0x' || substr(md5(concat_ws('|', 42, t.b, w.j)), 1, 8))::BIGINT % w.n AS j FROM range(1, 2001) t(b) CROSS JOIN widemetrics w) d
JOIN widemetrics v USING (j) GROUP BY b""")
oracle("promotion_gate", "widemetrics gatemeans fusedmetrics", """
SELECT round(base, 6) AS baseline_ndcg, round(cand, 6) AS candidate_ndcg, round(delta, 6) AS mean_delta, round(lo, 6) AS lower, round(hi, 6) AS upper,
       round(ok, 6) AS constraint_rate, cand > base AS mean_improved, lo > 0 AS interval_above_zero, ok = 1 AS constraints_met,
       cand > base AND lo > 0 AND ok = 1 AS passed, CASE WHEN NOT cand > base THEN 'mean NDCG@10 did not improve'
         WHEN NOT lo > 0 THEN 'confidence interval crosses zero' WHEN NOT ok = 1 THEN 'constraints were not satisfied for every user' ELSE '' END AS reason
FROM (SELECT (SELECT avg(pop) FROM widemetrics) AS base, (SELECT avg(fused) FROM widemetrics) AS cand, (SELECT avg(fused - pop) FROM widemetrics) AS delta,
  (SELECT quantile_cont(m, 0.025) FROM gatemeans) AS lo, (SELECT quantile_cont(m, 0.975) FROM gatemeans) AS hi,
  (SELECT avg(constraint_satisfied::INT) FROM fusedmetrics) AS ok)""")


@query("replay_check")
def _replay_check(x: Inputs):
    """A stored summary with one drifted and one missing entry, replayed from its per-user rows."""
    rows = stored(two_methods(x)[0], "metrics")
    names = ["itemcf_direct", "popularity"]
    summary = gates.summary_rows(rows, names)
    drifted = summary.filter("NOT (entry = 'popularity' AND field = 'mrr_at_10')").withColumn(
        "value", F.when((F.col("entry") == "itemcf_direct") & (F.col("field") == "ndcg_at_10"), F.col("value") + 0.5).otherwise(F.col("value"))
    )
    out = gates.replay_check(rows, stored(drifted, "summary"), names)
    return out.select("entry", "field", *rounded("replayed", "recorded"))


oracle("replay_check", "bothmetrics", """
SELECT 'itemcf_direct' AS entry, 'ndcg_at_10' AS field, round(avg(ndcg_at_10), 6) AS replayed, round(avg(ndcg_at_10) + 0.5, 6) AS recorded
FROM bothmetrics WHERE method = 'itemcf_direct'
UNION ALL SELECT 'popularity', 'mrr_at_10', round(avg(mrr_at_10), 6), NULL FROM bothmetrics WHERE method = 'popularity'""")


@query("seed_robustness")
def _seed_robustness(x: Inputs):
    """Order priorities as methods; every order feeds the seed its key picks."""
    seed = F.element_at(F.array(*[F.lit(s) for s in gates.POSTHOC_SEEDS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    table = x.table("orders").groupBy(F.col("o_orderpriority").alias("method"), seed.alias("seed")).agg(
        (F.avg("o_totalprice") / 1e6).alias("ndcg_at_10"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("recall_at_10")
    )
    out = gates.seed_robustness(table, ["ndcg_at_10", "recall_at_10"])
    return out.select("method", "metric", *longs("worst_seed"), *rounded("mean", "sample_std", "worst_value"))


oracle("seed_robustness", "", """
WITH s AS (SELECT o_orderpriority AS method, [42, 7, 2026][o_orderkey % 3 + 1] AS seed, o_orderkey % 3 AS ord, avg(o_totalprice) / 1e6 AS ndcg_at_10,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS recall_at_10 FROM orders GROUP BY ALL),
l AS (SELECT method, seed, ord, 'ndcg_at_10' AS metric, ndcg_at_10 AS v FROM s UNION ALL SELECT method, seed, ord, 'recall_at_10', recall_at_10 FROM s)
SELECT method, metric, CAST(first(seed ORDER BY v, ord) AS BIGINT) AS worst_seed, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std,
       round(min(v), 6) AS worst_value FROM l GROUP BY method, metric""")


@query("held_out_cases")
def _held_out_cases(x: Inputs):
    """Every evaluated user as a case: ItemCF on all rows minus the user's unseen ones, fused with text."""
    model = itemcf.itemcf_fit(x.inter)
    r = Routes(x)
    cf = stored(itemcf.held_out_retrieve(model, x.inter, x.seen.join(x.goals.select("user_id"), "user_id", "left_semi"), x.goals, x.items, r.depth), "heldout")
    sem = r.semantic()
    top = fusion.fuse("minmax_linear", cf, sem, x.items, r.states, k=10)
    hits = x.goals
    for name, route in (("final", top), ("itemcf", cf), ("semantic", sem)):
        hits = hits.join(route.select("user_id", "item_id", F.col("rank").alias(name)), ["user_id", "item_id"], "left")
    has = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    out = hits.agg(
        F.count(F.lit(1)).alias("cases"), has("final").alias("recall_at_10"), F.avg(F.coalesce(metrics.gain(F.col("final")), F.lit(0.0))).alias("ndcg_at_10"),
        has("itemcf").alias("itemcf_candidate_recall"), has("semantic").alias("semantic_candidate_recall"),
        F.avg((F.col("itemcf").isNotNull() | F.col("semantic").isNotNull()).cast("double")).alias("union_candidate_recall"),
    )
    return out.select(*longs("cases"), *rounded(*out.columns[1:]))


cte("ilikes", "inter", "SELECT user_id, item_id, count(*) AS own FROM inter WHERE rating >= 4 GROUP BY ALL")
cte("ipop", "inter", "SELECT item_id, count(*) AS p FROM inter WHERE rating >= 4 GROUP BY item_id")
cte("icounts", "ilikes", """
SELECT x.item_id AS src, y.item_id AS dst, count(*) AS n FROM ilikes x JOIN ilikes y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY ALL""")
cte("hidden", "ilikes seen", """
SELECT * FROM ilikes l WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = l.user_id AND z.item_id = l.item_id)""")
cte("heldscores", "seen goals icounts ipop hidden items", """
SELECT user_id, item_id, sum(c / sqrt(pi * pj)) AS score FROM (
  SELECT s.user_id, k.dst AS item_id, k.n - (h.own IS NOT NULL)::INT AS c, a.p AS pi, b.p - coalesce(h.own, 0) AS pj
  FROM seen s JOIN goals USING (user_id) JOIN icounts k ON k.src = s.item_id JOIN ipop a ON a.item_id = k.src JOIN ipop b ON b.item_id = k.dst
  LEFT JOIN hidden h ON h.user_id = s.user_id AND h.item_id = k.dst
  WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = s.user_id AND z.item_id = k.dst)) WHERE c > 0 AND pj > 0 GROUP BY ALL""".replace("JOIN goals USING (user_id)", "JOIN goals g0 ON g0.user_id = s.user_id"))
cte("heldall", "heldscores goals ipop hidden seen", """
SELECT user_id, item_id, score FROM heldscores UNION ALL
SELECT g.user_id, p.item_id, CAST(p.p - coalesce(h.own, 0) AS DOUBLE) FROM goals g CROSS JOIN ipop p LEFT JOIN hidden h ON h.user_id = g.user_id AND h.item_id = p.item_id
WHERE g.user_id NOT IN (SELECT user_id FROM heldscores) AND p.p - coalesce(h.own, 0) > 0
  AND NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = g.user_id AND z.item_id = p.item_id)""")
cte("heldrank", "heldall", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM heldall) WHERE rank <= 200""")
cte("heldfused", "heldrank semeval items likedgenres", f"""
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(0.5 * cm + 0.3 * sm + 0.2 * pref, 9) DESC, item_id) AS rank FROM (
  SELECT user_id, item_id, {OVER_USER('cs')} AS cm, {OVER_USER('ss')} AS sm, least(1.0, 0.5 + 0.25 * coalesce(len(list_intersect(i.genres, l.liked_genres)), 0)) AS pref
  FROM (SELECT user_id, item_id, max(cs) AS cs, max(ss) AS ss FROM (
    SELECT user_id, item_id, score AS cs, NULL::DOUBLE AS ss FROM heldrank UNION ALL SELECT user_id, item_id, NULL, score FROM semeval) GROUP BY ALL)
  JOIN items i USING (item_id) LEFT JOIN likedgenres l USING (user_id))""")
oracle("held_out_cases", "goals heldfused heldrank semeval", """
SELECT count(*) AS cases, round(avg((f.rank IS NOT NULL)::INT), 6) AS recall_at_10, round(avg(coalesce(1 / log2(1.0 + f.rank), 0.0)), 6) AS ndcg_at_10,
  round(avg((c.rank IS NOT NULL)::INT), 6) AS itemcf_candidate_recall, round(avg((s.rank IS NOT NULL)::INT), 6) AS semantic_candidate_recall,
  round(avg((c.rank IS NOT NULL OR s.rank IS NOT NULL)::INT), 6) AS union_candidate_recall
FROM goals g LEFT JOIN (SELECT * FROM heldfused WHERE rank <= 10) f USING (user_id, item_id) LEFT JOIN heldrank c USING (user_id, item_id)
LEFT JOIN semeval s USING (user_id, item_id)""")
