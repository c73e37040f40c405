"""Cohorts, cases, filters, quality checks and preference state."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import cases, cohorts, filters, itemcf, popularity, quality, splits, state
from recspark.plans.context import Inputs, longs, query, rounded
from recspark.plans.oracle import cte, oracle
from recspark.session import scratch_path
from recspark.sources import files, testdata

cte("cons", "", """
SELECT c_custkey AS user_id,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN ['STANDARD'] ELSE [] END AS required_genres,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ['PROMO'] WHEN c_mktsegment = 'MACHINERY' THEN ['SMALL'] ELSE [] END AS excluded_genres,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1960 END AS year_min,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1990 END AS year_max
FROM customer""")
cte("allowedcons", "cons items", """
SELECT c.user_id, i.item_id FROM cons c CROSS JOIN items i
WHERE list_has_all(i.genres, c.required_genres) AND NOT list_has_any(i.genres, c.excluded_genres)
  AND (c.year_min IS NULL OR coalesce(i.year >= c.year_min, false))
  AND (c.year_max IS NULL OR coalesce(i.year <= c.year_max, false))""")
cte("gcount", "hist items", """
SELECT user_id, genre, count(*) AS n
FROM (SELECT h.user_id, unnest(i.genres) AS genre FROM hist h JOIN items i USING (item_id)) GROUP BY ALL""")
cte("dgcount", "seen items", """
SELECT user_id, genre, count(*) AS n
FROM (SELECT h.user_id, unnest(i.genres) AS genre FROM seen h JOIN items i USING (item_id)) GROUP BY ALL""")
cte("likedgenres", "dgcount", """
SELECT user_id, list_sort(list(genre)) AS liked_genres FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rank FROM dgcount) WHERE rank <= 3 GROUP BY user_id""")
cte("patches", "items", """
SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn,
       event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, genres[1] AS g
FROM events LEFT JOIN items ON item_id = CAST(json_extract_string(props, '$.k') AS BIGINT)""")
cte("since", "patches", "SELECT session_id, max(turn) FILTER (WHERE event_type = 'signup') AS since FROM patches GROUP BY 1")
PATCH_VALUES = """
SELECT DISTINCT session_id, {turn} 'liked_ids' AS field, CAST(k AS VARCHAR) AS value FROM patches WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT DISTINCT session_id, {turn} 'excluded_ids', CAST(k AS VARCHAR) FROM patches WHERE event_type = 'error'
"""
cte("folded", "patches since", PATCH_VALUES.format(turn="") + """
UNION ALL SELECT DISTINCT session_id, 'liked_genres', g FROM patches JOIN since USING (session_id)
  WHERE event_type IN ('view', 'purchase', 'signup') AND g IS NOT NULL AND (since IS NULL OR turn >= since)
UNION ALL SELECT DISTINCT session_id, 'disliked_genres', g FROM patches JOIN since USING (session_id)
  WHERE event_type = 'error' AND g IS NOT NULL AND (since IS NULL OR turn >= since)
UNION ALL SELECT session_id, 'year_min', CAST(1950 + arg_max(k, turn) % 20 AS VARCHAR) FROM patches WHERE event_type = 'signup' GROUP BY 1
UNION ALL SELECT DISTINCT session_id, 'requested_count', '10' FROM patches
UNION ALL SELECT DISTINCT session_id, 'ranking_mode', 'balanced' FROM patches""")
cte("foldedsoft", "patches", PATCH_VALUES.format(turn="") + """
UNION ALL SELECT DISTINCT session_id, 'liked_genres', g FROM patches WHERE event_type IN ('view', 'purchase', 'signup') AND g IS NOT NULL
UNION ALL SELECT DISTINCT session_id, 'disliked_genres', g FROM patches WHERE event_type = 'error' AND g IS NOT NULL""")


@query("state_from_history")
def _state_from_history(x: Inputs):
    out = state.state_from_history(x.history, x.items)
    return out.select("user_id", F.array_join("liked_genres", ",").alias("liked_genres"), *longs("liked_count"))


oracle("state_from_history", "likedgenres seen", """
SELECT user_id, array_to_string(liked_genres, ',') AS liked_genres,
       (SELECT count(*) FROM seen z WHERE z.user_id = l.user_id) AS liked_count FROM likedgenres l""")


@query("favorite_genres")
def _favorite_genres(x: Inputs):
    return state.favorite_genres(x.history, x.items).select("user_id", "genre", *longs("n", "rank"))


oracle("favorite_genres", "gcount", """
SELECT user_id, genre, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rank FROM gcount""")


@query("cohort_ledger")
def _cohort_ledger(x: Inputs):
    """Historical = first tenth of eligible users; 20 / 30 / 30 % of the rest become cohorts."""
    eligible = x.goals.select("user_id")
    n = eligible.count()
    historical = splits.first_users(eligible, n // 10)
    excluded = x.users.join(x.table("customer").filter("c_acctbal < -500").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    pool = (
        eligible.join(historical, "user_id", "left_anti").join(excluded, "user_id", "left_anti").count()
    )
    sizes = {"development": pool * 2 // 10, "confirmation_a": pool * 3 // 10, "confirmation_b": pool * 3 // 10}
    return cohorts.cohort_ledger(eligible, historical, excluded, sizes, 42)


cte("pool", "goals", """
SELECT user_id, ('0x' || substr(md5(concat_ws('|', 42, user_id)), 1, 8))::BIGINT AS draw FROM goals
WHERE user_id NOT IN (SELECT user_id FROM goals ORDER BY user_id LIMIT (SELECT count(*) // 10 FROM goals))
  AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)""")
oracle("cohort_ledger", "pool", """
SELECT user_id, CASE WHEN p <= n * 2 // 10 THEN 'development'
                     WHEN p <= n * 2 // 10 + n * 3 // 10 THEN 'confirmation_a'
                     WHEN p <= n * 2 // 10 + 2 * (n * 3 // 10) THEN 'confirmation_b' ELSE 'reserve' END AS cohort
FROM (SELECT user_id, row_number() OVER (ORDER BY draw, user_id) AS p, count(*) OVER () AS n FROM pool)""")


@query("generate_cases")
def _generate_cases(x: Inputs):
    train, targets = splits.chronological_split(x.inter)
    made = cases.generate_cases(x.items, train, targets, 40, 10, 42)
    return made.select(
        "case_id", "user_id", F.array_join("turns", " / ").alias("turns"), "relevant_item",
        F.array_join("liked_genres", ",").alias("liked_genres"), "excluded_genre",
    )


cte("cgenres", "ctrain items", """
SELECT user_id, max(genre) FILTER (WHERE rank = 1) AS g1, max(genre) FILTER (WHERE rank = 2) AS g2 FROM (
  SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS rank
  FROM (SELECT t.user_id, unnest(i.genres) AS genre FROM ctrain t JOIN items i USING (item_id) WHERE t.rating >= 4)
  GROUP BY user_id, genre) GROUP BY user_id""")
cte("drawn", "ctargets cgenres items", """
SELECT t.user_id, t.test_item, g.g1, g.g2, i.genres AS tg,
       row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', 42, t.user_id)), 1, 8))::BIGINT, t.user_id) - 1 AS pos,
       count(*) OVER () AS n
FROM ctargets t JOIN cgenres g USING (user_id) JOIN items i ON i.item_id = t.test_item""")
cte("multi", "drawn items", """
SELECT *, row_number() OVER (ORDER BY (pos - least(40, n) + n) % n) - 1 AS slot FROM (
  SELECT d.*, (SELECT min(g) FROM (SELECT DISTINCT unnest(genres) AS g FROM items) v
               WHERE v.g <> d.g1 AND NOT list_contains(d.tg, v.g)) AS other FROM drawn d) WHERE other IS NOT NULL""")
oracle("generate_cases", "drawn multi", """
SELECT 'single-' || lpad(CAST(r + 1 AS VARCHAR), 3, '0') AS case_id, user_id,
       'I tend to enjoy ' || g1 || coalesce(', ' || g2, '') || '. Please recommend ten movies based on those preferences.' AS turns,
       test_item AS relevant_item, array_to_string(list_sort(list_filter([g1, g2], lambda z: z IS NOT NULL)), ',') AS liked_genres,
       CAST(NULL AS VARCHAR) AS excluded_genre
FROM range(40) t(r) JOIN drawn ON pos = r % n
UNION ALL
SELECT 'multi-' || lpad(CAST(r + 1 AS VARCHAR), 3, '0'), user_id,
       'I usually like ' || g1 || ' movies. / Please avoid ' || other || '. / Now give me ten recommendations and exclude movies I have seen.',
       test_item, g1, other
FROM range(10) t(r) JOIN multi ON slot = r""")


@query("cases_roundtrip")
def _cases_roundtrip(x: Inputs):
    """Cases written as JSON and read back with the fixed schema."""
    train, targets = splits.chronological_split(x.inter)
    hist = splits.positive_histories(train, x.items)
    liked = hist.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    none_ids, none_names = F.array().cast("array<bigint>"), F.array().cast("array<string>")

    def empty_state(genres):
        return F.struct(
            none_ids.alias("liked_ids"), none_ids.alias("disliked_ids"), none_ids.alias("excluded_ids"),
            genres.alias("liked_genres"), none_names.alias("disliked_genres"), none_names.alias("required_genres"),
            none_names.alias("excluded_genres"), F.lit(None).cast("int").alias("year_min"),
            F.lit(None).cast("int").alias("year_max"), F.lit(10).alias("requested_count"),
            F.lit("balanced").alias("ranking_mode"),
        )

    made = targets.join(liked, "user_id").select(
        F.concat(F.lit("case-"), F.col("user_id").cast("string")).alias("case_id"),
        "user_id",
        F.array(F.lit("hello")).alias("turns"),
        F.array("test_item").alias("relevant_ids"),
        empty_state(F.array(F.concat(F.lit("rows "), F.col("rows").cast("string")))).alias("initial_state"),
        empty_state(none_names).alias("expected_preferences"),
        F.array(F.lit("history-aware")).alias("tags"),
    )
    path = scratch_path(x.spark, "cases")
    files.write_cases(made, path)
    back = files.read_cases(x.spark, path, lines=True)
    return back.select(
        "case_id", "user_id", F.element_at("relevant_ids", 1).alias("relevant_item"),
        F.element_at("initial_state.liked_genres", 1).alias("note"), F.element_at("tags", 1).alias("tag"),
        F.col("initial_state.requested_count").cast("bigint").alias("requested_count"),
    )


oracle("cases_roundtrip", "ctargets ctrain", """
SELECT 'case-' || t.user_id AS case_id, t.user_id, t.test_item AS relevant_item, 'rows ' || count(*) AS note,
       'history-aware' AS tag, CAST(10 AS BIGINT) AS requested_count
FROM ctargets t JOIN ctrain c ON c.user_id = t.user_id AND c.rating >= 4 GROUP BY t.user_id, t.test_item""")


@query("stratified_subset")
def _stratified_subset(x: Inputs):
    sizes = {"BUILDING": 10, "FURNITURE": 15, "MACHINERY": 20}
    base = x.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("stratum"))
    return cohorts.stratified_subset(base, sizes, "stratum", "user_id")


oracle("stratified_subset", "", """
SELECT user_id, stratum FROM (
  SELECT c_custkey AS user_id, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
WHERE n <= CASE stratum WHEN 'BUILDING' THEN 10 WHEN 'FURNITURE' THEN 15 WHEN 'MACHINERY' THEN 20 ELSE 0 END""")


@query("table_fingerprint")
def _table_fingerprint(x: Inputs):
    return cohorts.table_fingerprint(x.inter, ["user_id", "item_id", "rating", "ts"])


oracle("table_fingerprint", "inter", """
SELECT rows, sha256(concat_ws('|', CAST(rows AS VARCHAR), """ + ", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(8)) + """)) AS fingerprint FROM (
  SELECT count(*) AS rows, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(8)) + """
  FROM (SELECT sha256(CAST(to_json({'c0': user_id::VARCHAR, 'c1': item_id::VARCHAR, 'c2': rating::VARCHAR, 'c3': ts::VARCHAR}) AS VARCHAR)) AS h FROM inter))""")


@query("hard_filter")
def _hard_filter(x: Inputs):
    """Size and id sum of every customer's allowed set."""
    return filters.allowed_summary(x.items, x.constraints, x.seen).select("user_id", *longs("allowed_count", "allowed_id_sum"))


oracle("hard_filter", "allowedcons users seen", """
SELECT u.user_id, count(a.item_id) AS allowed_count, CAST(coalesce(sum(a.item_id), 0) AS BIGINT) AS allowed_id_sum
FROM users u LEFT JOIN (SELECT * FROM allowedcons c
  WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = c.user_id AND z.item_id = c.item_id)) a USING (user_id)
GROUP BY u.user_id""")


@query("allowed_candidates")
def _allowed_candidates(x: Inputs):
    """ItemCF neighbours that pass the hard filter, ranked per user."""
    ranked = itemcf.itemcf_retrieve(x.model, x.seen, x.users, x.items, 20, x.constraints, x.seen)
    return ranked.select("user_id", "item_id", *longs("rank"), *rounded("score"))


oracle("allowed_candidates", "cfscores allowedcons", """
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.user_id ORDER BY round(score, 9) DESC, c.item_id) AS rank
  FROM cfscores c JOIN allowedcons a USING (user_id, item_id)) WHERE rank <= 20""")


def popular_top(x: Inputs):
    return popularity.popularity_topk(x.legal_positives, x.items, x.users, x.seen, 10)


@query("ranking_constraint_check")
def _ranking_constraint_check(x: Inputs):
    """Popularity lists, made without constraints, against each user's allowed set."""
    top = popular_top(x)
    allowed = filters.hard_filter(top, x.items, x.constraints)
    return filters.ranking_constraint_check(top, allowed, x.seen)


oracle("ranking_constraint_check", "poprank allowedcons seen", """
SELECT p.user_id, bool_and(a.item_id IS NOT NULL) AS within_allowed, bool_and(z.item_id IS NULL) AS unseen,
       bool_and(a.item_id IS NOT NULL AND z.item_id IS NULL) AS constraint_satisfied
FROM (SELECT * FROM poprank WHERE rank <= 10) p LEFT JOIN allowedcons a USING (user_id, item_id)
LEFT JOIN (SELECT DISTINCT user_id, item_id FROM seen) z USING (user_id, item_id) GROUP BY p.user_id""")


@query("constraint_audit")
def _constraint_audit(x: Inputs):
    """Popularity lists audited; items a user rated below 3 count as excluded ids."""
    excluded = x.inter.filter("rating < 3").select("user_id", "item_id")
    audit = filters.constraint_audit(popular_top(x), x.items, x.constraints, excluded)
    return audit.select("user_id", "constraint_satisfied", *longs("excluded_hits", "recommendations"))


cte("audit", "poprank allowedcons inter", """
SELECT p.user_id,
       bool_and(a.item_id IS NOT NULL AND e.item_id IS NULL) AS constraint_satisfied,
       count(e.item_id) AS excluded_hits, count(*) AS recommendations
FROM (SELECT * FROM poprank WHERE rank <= 10) p LEFT JOIN allowedcons a USING (user_id, item_id)
LEFT JOIN (SELECT DISTINCT user_id, item_id FROM inter WHERE rating < 3) e USING (user_id, item_id) GROUP BY p.user_id""")
oracle("constraint_audit", "audit", "SELECT * FROM audit")


@query("constraint_rates")
def _constraint_rates(x: Inputs):
    excluded = x.inter.filter("rating < 3").select("user_id", "item_id")
    audit = filters.constraint_audit(popular_top(x), x.items, x.constraints, excluded)
    return filters.audit_rates(audit).select(*rounded("constraint_satisfaction_rate", "excluded_item_violation_rate"))


oracle("constraint_rates", "audit", """
SELECT round(avg(CAST(constraint_satisfied AS DOUBLE)), 6) AS constraint_satisfaction_rate,
       round(sum(excluded_hits) / CAST(sum(recommendations) AS DOUBLE), 6) AS excluded_item_violation_rate FROM audit""")


@query("case_relevance_report")
def _case_relevance_report(x: Inputs):
    """Test targets that break the user's own constraints or were seen before."""
    labels = x.targets.select("user_id", F.col("test_item").alias("item_id"))
    blocked = x.inter.filter("rating < 4").select("user_id", "item_id")
    return cases.case_relevance_report(labels, x.items, x.constraints, blocked)


oracle("case_relevance_report", "targets items cons inter", """
SELECT user_id, item_id, reasons FROM (
  SELECT t.user_id, t.test_item AS item_id, array_to_string(list_filter([
    CASE WHEN EXISTS (SELECT 1 FROM inter b WHERE b.rating < 4 AND b.user_id = t.user_id AND b.item_id = t.test_item) THEN 'id is ruled out' END,
    CASE WHEN list_has_any(i.genres, c.excluded_genres) THEN 'has unwanted genre ' || array_to_string(list_sort(list_intersect(i.genres, c.excluded_genres)), ', ') END,
    CASE WHEN NOT list_has_all(i.genres, c.required_genres) THEN 'lacks a wanted genre' END,
    CASE WHEN c.year_min IS NOT NULL AND coalesce(i.year < c.year_min, true) THEN 'older than asked' END,
    CASE WHEN c.year_max IS NOT NULL AND coalesce(i.year > c.year_max, true) THEN 'newer than asked' END], lambda z: z IS NOT NULL), '; ') AS reasons
  FROM targets t JOIN items i ON i.item_id = t.test_item JOIN cons c ON c.user_id = t.user_id) WHERE reasons <> ''""")


def patches(x: Inputs):
    return testdata.patches(x.spark, x.sf_dir)


@query("preference_patches")
def _preference_patches(x: Inputs):
    first = lambda c: F.get(F.col(c).cast("array<string>"), F.lit(0)).alias(c)
    return patches(x).select(
        "session_id", *longs("turn"), "replace_soft", first("liked_ids"), first("excluded_ids"), first("liked_genres"),
        first("disliked_genres"), *longs("year_min"),
    )


oracle("preference_patches", "patches", """
SELECT session_id, CAST(turn AS BIGINT) AS turn, event_type = 'signup' AS replace_soft,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(k AS VARCHAR) END AS liked_ids,
  CASE WHEN event_type = 'error' THEN CAST(k AS VARCHAR) END AS excluded_ids,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN g END AS liked_genres,
  CASE WHEN event_type = 'error' THEN g END AS disliked_genres,
  CASE WHEN event_type = 'signup' THEN 1950 + k % 20 END AS year_min FROM patches""")


@query("fold_preferences")
def _fold_preferences(x: Inputs):
    return state.fold_preferences(patches(x))


oracle("fold_preferences", "folded", "SELECT session_id, field, value FROM folded")


@query("stateless_preferences")
def _stateless_preferences(x: Inputs):
    return state.stateless_preferences(patches(x)).select("session_id", *longs("turn"), "field", "value")


oracle("stateless_preferences", "patches", PATCH_VALUES.format(turn="CAST(turn AS BIGINT) AS turn,") + """
UNION ALL SELECT session_id, turn, 'liked_genres', g FROM patches WHERE event_type IN ('view', 'purchase', 'signup') AND g IS NOT NULL
UNION ALL SELECT session_id, turn, 'disliked_genres', g FROM patches WHERE event_type = 'error' AND g IS NOT NULL
UNION ALL SELECT session_id, turn, 'year_min', CAST(1950 + k % 20 AS VARCHAR) FROM patches WHERE event_type = 'signup'
UNION ALL SELECT session_id, turn, 'requested_count', '10' FROM patches
UNION ALL SELECT session_id, turn, 'ranking_mode', 'balanced' FROM patches""")


@query("preference_retention")
def _preference_retention(x: Inputs):
    """The folded state against an expectation that never forgets soft genres."""
    rows = patches(x)
    actual = state.fold_preferences(rows)
    keep = rows.withColumn("replace_soft", F.lit(False))
    return filters.preference_retention(actual, state.fold_preferences(keep))


oracle("preference_retention", "folded foldedsoft", """
SELECT w.session_id, bool_and(h.value IS NOT NULL) AS retained
FROM foldedsoft w LEFT JOIN (
  SELECT session_id, field, value FROM folded UNION SELECT session_id, 'disliked_genres', value FROM folded WHERE field = 'excluded_genres') h
USING (session_id, field, value) GROUP BY w.session_id""")


@query("finite_checks")
def _finite_checks(x: Inputs):
    """Ratios of line prices with planted non-finite cells."""
    li = x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    bad = li.select(
        *longs("l_orderkey", "l_linenumber", "l_partkey"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("discount"),
    )
    return quality.check_finite(bad, ["l_orderkey", "l_linenumber", "l_partkey"], ["price", "discount"]).drop("value")


oracle("finite_checks", "", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, 'price' AS feature FROM lineitem WHERE l_orderkey % 97 = 0
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), l_partkey, 'discount' FROM lineitem WHERE l_partkey % 89 = 0""")


@query("vector_checks")
def _vector_checks(x: Inputs):
    raw = x.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bent = raw.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, F.slice("v", 1, 63))
        .when(F.col("vec_id") % 11 == 0, F.transform("v", lambda e: e * 0))
        .when(F.col("vec_id") % 13 == 0, F.transform("v", lambda e: e * 2))
        .otherwise(F.col("v")).alias("v"),
    )
    return quality.check_vectors(bent, "vec_id", "v", 64, unit=True)


oracle("vector_checks", "", """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'zero norm' ELSE 'not normalized' END AS reason
FROM embeddings
WHERE vec_id % 7 = 0 OR vec_id % 11 = 0
   OR abs(sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) * CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 1 END - 1) > 1e-5""")


@query("user_alignment_check")
def _user_alignment_check(x: Inputs):
    """Order rows as evidence: duplicate and extra users against customers in credit."""
    evidence = x.table("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("ndcg_at_10"),
        F.lit(True).alias("constraint_satisfied"),
    )
    cohort = x.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return quality.check_user_alignment(evidence, cohort, ["ndcg_at_10"])


oracle("user_alignment_check", "", """
WITH have AS (SELECT o_custkey AS user_id, count(*) AS n, bool_or(o_orderkey % 50 = 0) AS invalid FROM orders GROUP BY 1),
want AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 0)
SELECT user_id, 'duplicate' AS problem FROM have WHERE n > 1
UNION ALL SELECT user_id, 'missing' FROM want WHERE user_id NOT IN (SELECT user_id FROM have)
UNION ALL SELECT user_id, 'extra' FROM have WHERE user_id NOT IN (SELECT user_id FROM want)
UNION ALL SELECT user_id, 'invalid' FROM have WHERE invalid""")
