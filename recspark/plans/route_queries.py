"""Text and vector routes, candidate features, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import candidates, dense, fusion, itemcf, text
from recspark.operators.state import state_from_history
from recspark.plans.context import Inputs, longs, query, rounded
from recspark.plans.oracle import cte, oracle
from recspark.session import scratch_path, stored
from recspark.sources import files, testdata

DEPTH, CAP = 200, 20


class Routes:
    """The three retrieval routes of the evaluated users, each made and written once."""

    def __init__(self, x: Inputs, depth: int = DEPTH):
        self.x, self.made = x, {}
        self.states = stored(state_from_history(x.history, x.items), "states")
        self.depth = depth

    def itemcf(self):
        x = self.x
        if "itemcf" not in self.made:
            self.made["itemcf"] = itemcf.itemcf_retrieve(x.model, x.seen, x.goals, x.items, self.depth)
        return self.made["itemcf"]

    def semantic(self, cap: int = CAP, style: str = "baseline"):
        if (cap, style) not in self.made:
            self.made[cap, style] = self._semantic(cap, style)
        return self.made[cap, style]

    def _semantic(self, cap: int, style: str):
        x = self.x
        vectors, idf = text.tfidf_fit(x.items)
        profiles = text.semantic_profile(self.states, x.seen, x.items, cap, style)
        users = profiles.join(x.goals.select("user_id"), "user_id", "left_semi")
        return text.tfidf_retrieve(vectors, idf, users, self.depth, x.seen)

    def dense(self):
        x = self.x
        vectors = dense.embed_normalize(testdata.item_embeddings(x.spark, x.sf_dir))
        queries = dense.mean_vector(x.seen.join(x.goals.select("user_id"), "user_id", "left_semi"), vectors)
        return dense.dense_retrieve(vectors, queries, self.depth, x.seen)


cte("tf", "items", """
SELECT item_id, token, count(*) AS tf
FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM items) GROUP BY ALL""")
cte("idf", "tf items", """
SELECT token, ln((1 + (SELECT count(*) FROM items)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY token""")
cte("tfidf", "tf idf", """
SELECT item_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS weight FROM tf JOIN idf USING (token)""")
cte("evalstates", "likedgenres goals", "SELECT * FROM likedgenres WHERE user_id IN (SELECT user_id FROM goals)")


def profile_cte(name: str, cap: int, part: str, lead: str) -> None:
    cte(name, "seen items evalstates", f"""
SELECT s.user_id, array_to_string(list_concat({lead}, coalesce(p.parts, [])), ' ') AS text
FROM evalstates s LEFT JOIN (
  SELECT user_id, list({part} ORDER BY item_id) AS parts FROM (
    SELECT z.user_id, i.*, row_number() OVER (PARTITION BY z.user_id ORDER BY z.item_id) AS n FROM seen z JOIN items i USING (item_id))
  WHERE n <= {cap} GROUP BY user_id) p USING (user_id)""")


BASELINE = ("text", "list_concat([''], s.liked_genres)")
TITLES = ("title", "[]::VARCHAR[]")
TITLES_GENRES_YEAR = ("title || coalesce(' (' || year || ')', '') || ' ' || array_to_string(genres, ' ')", "s.liked_genres")


def semantic_cte(name: str, profile: str) -> None:
    """All unseen items of each profile with a positive cosine, ranked."""
    cte(name, f"{profile} tfidf idf seen", f"""
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT q.user_id, d.item_id, sum(q.weight * d.weight) AS score FROM (
    SELECT user_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY user_id)) AS weight FROM (
      SELECT user_id, token, count(*) AS tf
      FROM (SELECT user_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {profile}) GROUP BY ALL) JOIN idf USING (token)) q
  JOIN tfidf d USING (token) GROUP BY ALL) s
WHERE round(score, 9) > 0 AND NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = s.user_id AND z.item_id = s.item_id)""")


profile_cte("profile20", 20, *BASELINE)
semantic_cte("semrank", "profile20")
cte("vec", "", """
SELECT vec_id, v, v::DOUBLE[64] AS a FROM (
  SELECT vec_id, list(x / norm ORDER BY pos) AS v FROM (
    SELECT vec_id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings)) GROUP BY vec_id)""")
cte("uservec", "seen vec goals", """
SELECT user_id, list(m / norm ORDER BY pos)::DOUBLE[64] AS a FROM (
  SELECT user_id, pos, m, sqrt(sum(m * m) OVER (PARTITION BY user_id)) AS norm FROM (
    SELECT user_id, pos, avg(e) AS m FROM (
      SELECT s.user_id, unnest(v.v) AS e, unnest(range(64)) AS pos
      FROM seen s JOIN vec v ON v.vec_id = s.item_id % (SELECT count(*) FROM vec)
      WHERE s.user_id IN (SELECT user_id FROM goals)) GROUP BY ALL)) GROUP BY user_id""")
cte("denserank", "uservec vec items seen", """
SELECT s.user_id, i.item_id, s.score, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 9) DESC, i.item_id) AS rank
FROM (SELECT u.user_id, v.vec_id, array_inner_product(u.a, v.a) AS score FROM uservec u CROSS JOIN vec v) s
JOIN items i ON i.item_id % (SELECT count(*) FROM vec) = s.vec_id
WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = s.user_id AND z.item_id = i.item_id)""")
cte("cfeval", "cfrank goals", f"SELECT * FROM cfrank WHERE rank <= {DEPTH} AND user_id IN (SELECT user_id FROM goals)")
cte("semeval", "semrank", f"SELECT * FROM semrank WHERE rank <= {DEPTH}")
cte("denseeval", "denserank", f"SELECT * FROM denserank WHERE rank <= {DEPTH}")


def ranked_columns(df):
    return df.select("user_id", "item_id", *longs("rank"), *rounded("score"))


@query("tfidf_fit")
def _tfidf_fit(x: Inputs):
    vectors, _ = text.tfidf_fit(x.items)
    return text.vector_rows(vectors).select("item_id", "token", *rounded("weight"))


oracle("tfidf_fit", "tfidf", "SELECT item_id, token, round(weight, 6) AS weight FROM tfidf")


@query("tfidf_documents")
def _tfidf_documents(x: Inputs):
    """Benchmark passages as queries against the whole document corpus."""
    docs = x.table("documents").select(F.col("doc_id").alias("item_id"), "text")
    vectors, idf = text.tfidf_fit(docs)
    queries = x.table("benchmark").select(F.col("item_id").alias("user_id"), "text")
    found = text.tfidf_retrieve(vectors, idf, queries, 100)
    return found.select(F.col("user_id").alias("benchmark_id"), F.col("item_id").alias("doc_id"), *longs("rank"), *rounded("score"))


oracle("tfidf_documents", "", """
WITH tf AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
idf AS MATERIALIZED (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY token),
d AS MATERIALIZED (SELECT doc_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN idf USING (token)),
q AS MATERIALIZED (SELECT item_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM (
    SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL)
  JOIN idf USING (token)),
s AS MATERIALIZED (SELECT item_id, doc_id, sum(q.w * d.w) AS score FROM q JOIN d USING (token) GROUP BY ALL)
SELECT benchmark_id, doc_id, rank, round(score, 6) AS score FROM (
  SELECT item_id AS benchmark_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM s WHERE round(score, 9) > 0) WHERE rank <= 100""")


@query("tfidf_retrieve")
def _tfidf_retrieve(x: Inputs):
    return ranked_columns(Routes(x).semantic())


oracle("tfidf_retrieve", "semeval", "SELECT user_id, item_id, rank, round(score, 6) AS score FROM semeval")


@query("tfidf_constrained")
def _tfidf_constrained(x: Inputs):
    """The text route under each customer's hard constraints, which act before the top 20."""
    vectors, idf = text.tfidf_fit(x.items)
    profiles = text.semantic_profile(state_from_history(x.history, x.items), x.seen, x.items, CAP, "baseline")
    users = profiles.join(x.goals.select("user_id"), "user_id", "left_semi")
    return ranked_columns(text.tfidf_retrieve(vectors, idf, users, 20, x.seen, x.constraints, x.items))


oracle("tfidf_constrained", "semrank allowedcons", """
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (
  SELECT s.user_id, s.item_id, s.score, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 9) DESC, s.item_id) AS rank
  FROM semrank s JOIN allowedcons a ON a.user_id = s.user_id AND a.item_id = s.item_id) WHERE rank <= 20""")


def _profile_query(name: str, style: str, cap: int):
    @query(name)
    def run(x: Inputs):
        states = state_from_history(x.history, x.items).join(x.goals.select("user_id"), "user_id", "left_semi")
        return text.semantic_profile(states, x.seen, x.items, cap, style)


_profile_query("semantic_profile", "baseline", 20)
oracle("semantic_profile", "profile20", "SELECT user_id, text FROM profile20")
_profile_query("semantic_profile_titles", "titles-only", 50)
profile_cte("profiletitles", 50, *TITLES)
oracle("semantic_profile_titles", "profiletitles", "SELECT user_id, text FROM profiletitles")
_profile_query("semantic_profile_titles_genres_year", "titles-genres-year", 50)
profile_cte("profiletgy", 50, *TITLES_GENRES_YEAR)
oracle("semantic_profile_titles_genres_year", "profiletgy", "SELECT user_id, text FROM profiletgy")


@query("embed_normalize")
def _embed_normalize(x: Inputs):
    scaled = x.table("embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * 3).alias("embedding"))
    out = dense.embed_normalize(scaled)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(total, 6).alias("total"))


oracle("embed_normalize", "vec", "SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM vec")


@query("embedding_roundtrip")
def _embedding_roundtrip(x: Inputs):
    """Encoded catalog written with its parameters and read back."""
    vectors = dense.embed_normalize(testdata.item_embeddings(x.spark, x.sf_dir))
    path = scratch_path(x.spark, "vectors")
    files.write_vectors(vectors, path, dimension=64, normalized=True)
    back, params = files.read_vectors(x.spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    dimension = F.broadcast(params.select(F.col("dimension").cast("bigint").alias("dimension"), F.lit(1).alias("one")))
    return back.select("item_id", F.round(total, 6).alias("total"), F.lit(1).alias("one")).join(dimension, "one").drop("one")


oracle("embedding_roundtrip", "vec items", """
SELECT item_id, round(list_sum(v), 6) AS total, CAST(64 AS BIGINT) AS dimension
FROM items JOIN vec ON vec_id = item_id % (SELECT count(*) FROM vec)""")


@query("dense_retrieve")
def _dense_retrieve(x: Inputs):
    return ranked_columns(Routes(x).dense())


oracle("dense_retrieve", "denseeval", "SELECT user_id, item_id, rank, round(score, 6) AS score FROM denseeval")


@query("dense_constrained")
def _dense_constrained(x: Inputs):
    """The vector route under each customer's hard constraints, which act before the top 20."""
    vectors = dense.embed_normalize(testdata.item_embeddings(x.spark, x.sf_dir))
    queries = dense.mean_vector(x.seen.join(x.goals.select("user_id"), "user_id", "left_semi"), vectors)
    return ranked_columns(dense.dense_retrieve(vectors, queries, 20, x.seen, states=x.constraints, catalog=x.items))


oracle("dense_constrained", "denserank allowedcons", """
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (
  SELECT s.user_id, s.item_id, s.score, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 9) DESC, s.item_id) AS rank
  FROM denserank s JOIN allowedcons a ON a.user_id = s.user_id AND a.item_id = s.item_id) WHERE rank <= 20""")


@query("candidate_union")
def _candidate_union(x: Inputs):
    r = Routes(x)
    union = candidates.candidate_union(itemcf=r.itemcf(), dense=r.dense(), latent=r.semantic())
    return union.select("user_id", "item_id", "in_itemcf", "in_dense", "in_latent", *longs("itemcf_rank", "dense_rank", "latent_rank"))


cte("cunion", "cfeval denseeval semeval", """
SELECT user_id, item_id, max(cs) AS cs, max(cr) AS cr, max(ds) AS ds, max(dr) AS dr, max(ls) AS ls, max(lr) AS lr FROM (
  SELECT user_id, item_id, score AS cs, rank AS cr, NULL::DOUBLE AS ds, NULL::BIGINT AS dr, NULL::DOUBLE AS ls, NULL::BIGINT AS lr FROM cfeval
  UNION ALL SELECT user_id, item_id, NULL, NULL, score, rank, NULL, NULL FROM denseeval
  UNION ALL SELECT user_id, item_id, NULL, NULL, NULL, NULL, score, rank FROM semeval) GROUP BY ALL""")
oracle("candidate_union", "cunion", """
SELECT user_id, item_id, cr IS NOT NULL AS in_itemcf, dr IS NOT NULL AS in_dense, lr IS NOT NULL AS in_latent,
       cr AS itemcf_rank, dr AS dense_rank, lr AS latent_rank FROM cunion""")


@query("route_rank")
def _route_rank(x: Inputs):
    return candidates.route_rank(Routes(x).itemcf().drop("rank")).select("user_id", "item_id", *longs("rank"), *rounded("reciprocal_rank"))


oracle("route_rank", "cfeval", "SELECT user_id, item_id, rank, round(1.0 / rank, 6) AS reciprocal_rank FROM cfeval")


@query("route_percentile")
def _route_percentile(x: Inputs):
    return candidates.route_percentile(Routes(x).dense()).select("user_id", "item_id", *rounded("percentile"))


oracle("route_percentile", "denseeval", """
SELECT user_id, item_id, round((count(*) OVER (PARTITION BY user_id) - rank() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC) + 1)
  / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS percentile FROM denseeval""")


@query("minmax_normalize")
def _minmax_normalize(x: Inputs):
    return fusion.minmax_normalize(Routes(x).itemcf()).select("user_id", "item_id", *rounded("normalized"))


MINMAX = """CASE WHEN abs(max({s}) OVER w - min({s}) OVER w) <= 1e-9 * greatest(abs(max({s}) OVER w), abs(min({s}) OVER w)) THEN 1.0
  ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"""
oracle("minmax_normalize", "cfeval", f"""
SELECT user_id, item_id, round({MINMAX.format(s='score')}, 6) AS normalized FROM cfeval WINDOW w AS (PARTITION BY user_id)""")


@query("rrf_scores")
def _rrf_scores(x: Inputs):
    return fusion.rrf_scores(Routes(x).dense(), 60).select("user_id", "item_id", *rounded("rrf"))


oracle("rrf_scores", "denseeval", "SELECT user_id, item_id, round(1.0 / (60 + rank), 6) AS rrf FROM denseeval")


@query("percentile_scores")
def _percentile_scores(x: Inputs):
    return fusion.percentile_scores(Routes(x).dense()).select("user_id", "item_id", *rounded("percentile"))


oracle("percentile_scores", "denseeval", """
SELECT user_id, item_id, round(1 - percent_rank() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC), 6) AS percentile FROM denseeval""")


@query("affinity_fusion")
def _affinity_fusion(x: Inputs):
    """Affinity of ItemCF candidates, with the excluded genres of the segment as disliked ones."""
    r = Routes(x)
    disliked = x.constraints.select("user_id", F.col("excluded_genres").alias("disliked_genres"))
    states = r.states.join(disliked, "user_id", "left")
    return candidates.affinity_fusion(r.itemcf(), x.items, states).select("user_id", "item_id", *rounded("affinity"))


oracle("affinity_fusion", "cfeval items likedgenres cons", """
SELECT c.user_id, c.item_id, greatest(0.0, least(1.0, 0.5 + 0.25 * coalesce(len(list_intersect(i.genres, l.liked_genres)), 0)
  - 0.5 * coalesce(len(list_intersect(i.genres, k.excluded_genres)), 0)))::DOUBLE AS affinity
FROM cfeval c JOIN items i USING (item_id) LEFT JOIN likedgenres l USING (user_id) LEFT JOIN cons k USING (user_id)""")


@query("affinity_feature")
def _affinity_feature(x: Inputs):
    """Affinity with item terms: seen items count as liked, low-rated ones as disliked."""
    r = Routes(x)
    pairs = x.inter.select("user_id", "item_id").distinct()
    low = x.inter.filter("rating <= 2").select("user_id", "item_id").distinct().withColumn("disliked", F.lit(1.0))
    marks = x.seen.withColumn("liked", F.lit(1.0)).join(low, ["user_id", "item_id"], "full_outer")
    return candidates.affinity_feature(pairs, x.items, r.states, marks).select("user_id", "item_id", *rounded("affinity"))


oracle("affinity_feature", "inter items likedgenres seen", """
SELECT p.user_id, p.item_id, greatest(0.0, least(1.0, 0.5 + 0.25 * coalesce(len(list_intersect(i.genres, l.liked_genres)), 0)
  + 0.5 * (s.item_id IS NOT NULL)::INT - (d.item_id IS NOT NULL)::INT))::DOUBLE AS affinity
FROM (SELECT DISTINCT user_id, item_id FROM inter) p JOIN items i USING (item_id) LEFT JOIN likedgenres l USING (user_id)
LEFT JOIN seen s USING (user_id, item_id)
LEFT JOIN (SELECT DISTINCT user_id, item_id FROM inter WHERE rating <= 2) d USING (user_id, item_id)""")


def feature_table(x: Inputs, version: str, calibration: str = "raw", latent=None):
    """Features of the evaluated users; without a ``latent`` route the text route stands in for it."""
    r = Routes(x)
    routes = {"itemcf": r.itemcf(), "dense": r.dense()}
    if version != "v1":
        routes["latent"] = r.semantic() if latent is None else latent
    union = candidates.candidate_union(**routes)
    recent = None
    if version == "v2b":
        union = stored(union, "union")
        recent = itemcf.recent_itemcf(x.model, x.history, union)
    return candidates.candidate_features(
        union, x.items, x.history, x.fit_rows, r.states, recent, calibration, version
    )


cte("userprofile", "hist items", """
SELECT user_id, list_distinct(flatten(list(genres))) AS hg, list(DISTINCT year) FILTER (WHERE year IS NOT NULL) AS hy,
       list_sort(list(year) FILTER (WHERE year IS NOT NULL))[count(year) // 2 + 1] AS median_year
FROM hist JOIN items USING (item_id) GROUP BY user_id""")


def feature_cte(name: str, union: str, calibrated: bool = False) -> None:
    score = lambda s: f"coalesce({s}, 0.0)"
    if calibrated:
        score = lambda s: (
            f"CASE WHEN {s} IS NULL THEN 0.0 ELSE (count({s}) OVER (PARTITION BY c.user_id) - rank() OVER "
            f"(PARTITION BY c.user_id, {s} IS NULL ORDER BY round({s}, 9) DESC) + 1) / CAST(count({s}) OVER (PARTITION BY c.user_id) AS DOUBLE) END"
        )
    cte(name, f"{union} items pop userprofile likedgenres recentscores", f"""
SELECT c.user_id, c.item_id, {score('cs')} AS itemcf_score, coalesce(1.0 / cr, 0.0) AS itemcf_reciprocal_rank,
       {score('ds')} AS dense_score, coalesce(1.0 / dr, 0.0) AS dense_reciprocal_rank,
       ln(1.0 + coalesce(p.popularity, 0)) AS log1p_popularity,
       len(list_intersect(u.hg, i.genres)) / CAST(len(list_distinct(list_concat(u.hg, i.genres))) AS DOUBLE) AS history_genre_jaccard,
       CASE WHEN i.year IS NOT NULL AND list_contains(u.hy, i.year) THEN 1.0 ELSE 0.0 END AS history_year_match,
       least(1.0, 0.5 + 0.25 * len(list_intersect(i.genres, l.liked_genres))) AS preference_affinity,
       CASE WHEN cr IS NULL THEN 0.0 ELSE 1.0 END AS in_itemcf, CASE WHEN dr IS NULL THEN 0.0 ELSE 1.0 END AS in_dense,
       {score('ls')} AS latent_score, coalesce(1.0 / lr, 0.0) AS latent_reciprocal_rank,
       CASE WHEN lr IS NULL THEN 0.0 ELSE 1.0 END AS in_latent,
       {score('cs')} * {score('ls')} AS itemcf_latent_cross, coalesce(r.score, 0.0) AS recent_itemcf_score,
       coalesce(abs(i.year - u.median_year), 0.0) AS year_recency
FROM {union} c JOIN items i USING (item_id) LEFT JOIN pop p USING (item_id) LEFT JOIN userprofile u USING (user_id)
LEFT JOIN likedgenres l USING (user_id) LEFT JOIN recentscores r ON r.user_id = c.user_id AND r.item_id = c.item_id""")


cte("cunion2", "cfeval denseeval", """
SELECT user_id, item_id, max(cs) AS cs, max(cr) AS cr, max(ds) AS ds, max(dr) AS dr, NULL::DOUBLE AS ls, NULL::BIGINT AS lr FROM (
  SELECT user_id, item_id, score AS cs, rank AS cr, NULL::DOUBLE AS ds, NULL::BIGINT AS dr FROM cfeval
  UNION ALL SELECT user_id, item_id, NULL, NULL, score, rank FROM denseeval) GROUP BY user_id, item_id""")
feature_cte("feat1", "cunion2")
feature_cte("feat1p", "cunion2", True)
feature_cte("feat2b", "cunion")


def _feature_query(name: str, version: str, source: str, calibration: str = "raw"):
    columns = candidates.FEATURES[version]

    @query(name)
    def run(x: Inputs):
        return feature_table(x, version, calibration).select("user_id", "item_id", *rounded(*columns))

    picks = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)
    oracle(name, source, f"SELECT user_id, item_id, {picks} FROM {source}")


_feature_query("candidate_features_v1", "v1", "feat1")
_feature_query("candidate_features_v1_percentile", "v1", "feat1p", "percentile")
_feature_query("candidate_features_v2", "v2", "feat2b")
_feature_query("candidate_features_v2b", "v2b", "feat2b")


def fusion_cte(name: str, kind: str) -> None:
    both = """
  SELECT user_id, item_id, max(cs) AS cs, max(cr) AS cr, max(ss) AS ss, max(sr) AS sr FROM (
    SELECT user_id, item_id, score AS cs, rank AS cr, NULL::DOUBLE AS ss, NULL::BIGINT AS sr FROM cfeval
    UNION ALL SELECT user_id, item_id, NULL, NULL, score, rank FROM semeval) GROUP BY user_id, item_id"""
    part = lambda s: {
        "minmax": f"CASE WHEN {s}s IS NULL THEN 0.0 ELSE " + MINMAX.format(s=f"{s}s").replace("OVER w", "OVER (PARTITION BY u.user_id)") + " END",
        "percentile": f"CASE WHEN {s}s IS NULL THEN 0.0 ELSE 1 - percent_rank() OVER (PARTITION BY u.user_id, {s}s IS NULL ORDER BY round({s}s, 9) DESC) END",
        "rrf": f"coalesce(1.0 / (60 + {s}r), 0.0)",
        "itemcf": f"coalesce({s}s, 0.0)",
    }[kind]
    source = "SELECT user_id, item_id, score AS cs, rank AS cr, NULL::DOUBLE AS ss, NULL::BIGINT AS sr FROM cfeval" if kind == "itemcf" else both
    final = {"rrf": "cf + sem", "itemcf": "cf"}.get(kind, "0.5 * cf + 0.3 * sem + 0.2 * preference")
    cte(name, "cfeval semeval items likedgenres", f"""
SELECT user_id, item_id, cf AS itemcf, sem AS semantic, preference, score,
       row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
FROM (SELECT *, {final} AS score FROM (
  SELECT u.user_id, u.item_id, {part('c')} AS cf, {part('s')} AS sem,
         least(1.0, 0.5 + 0.25 * coalesce(len(list_intersect(i.genres, l.liked_genres)), 0)) AS preference
  FROM ({source}) u JOIN items i USING (item_id) LEFT JOIN likedgenres l USING (user_id)))""")


def _fusion_query(kind: str, short: str):
    @query(f"fuse_{kind}")
    def run(x: Inputs):
        r = Routes(x)
        sem = None if kind == "itemcf" else r.semantic()
        top = fusion.fuse(kind, r.itemcf(), sem, x.items, r.states, k=10)
        return top.select("user_id", "item_id", *longs("rank"), *rounded("itemcf", "semantic", "preference", "score"))

    fusion_cte(f"fused_{short}", short)
    oracle(f"fuse_{kind}", f"fused_{short}", f"""
SELECT user_id, item_id, rank, round(CAST(itemcf AS DOUBLE), 6) AS itemcf, round(CAST(semantic AS DOUBLE), 6) AS semantic,
       round(CAST(preference AS DOUBLE), 6) AS preference, round(CAST(score AS DOUBLE), 6) AS score FROM fused_{short} WHERE rank <= 10""")


for _kind, _short in (("itemcf", "itemcf"), ("minmax_linear", "minmax"), ("rrf", "rrf"), ("percentile_linear", "percentile")):
    _fusion_query(_kind, _short)


@query("explain_reason")
def _explain_reason(x: Inputs):
    r = Routes(x)
    top = fusion.fuse("minmax_linear", r.itemcf(), r.semantic(), x.items, r.states, k=10).select("user_id", "item_id")
    return fusion.explain_reason(top, x.items, r.states)


oracle("explain_reason", "fused_minmax items likedgenres", """
SELECT f.user_id, f.item_id, CASE WHEN len(list_intersect(i.genres, l.liked_genres)) > 0
  THEN 'Matches preferred genres: ' || array_to_string(list_sort(list_intersect(i.genres, l.liked_genres)), ', ') || '.'
  ELSE 'Selected by collaborative and semantic relevance.' END AS reason
FROM fused_minmax f JOIN items i USING (item_id) LEFT JOIN likedgenres l USING (user_id) WHERE f.rank <= 10""")
