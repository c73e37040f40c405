import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from recspark.operators import als, bpr, dense, filters, graph, itemcf, popularity, text
from recspark.functions.ordering import linear_percentile, nearest_rank

INTER = "user_id bigint, item_id bigint, rating int, ts bigint, row_key int"


def catalog(spark, n):
    return spark.createDataFrame([(i, f"item {i}", ["g"], 2000, f"item {i} g") for i in range(n)],
                                 "item_id bigint, title string, genres array<string>, year int, text string")


def random_inter(spark, users=30, items=25, seed=1):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        for _ in range(4 if u else 60):  # user 0 is far heavier than the rest
            rows.append((u, rng.randrange(items), rng.choice([3, 4, 5]), rng.randrange(100), len(rows)))
    return spark.createDataFrame(rows, INTER), rows


def brute_itemcf(rows, history, items):
    likes, pop = defaultdict(set), Counter()
    for u, i, r, _, _ in rows:
        if r >= 4:
            likes[u].add(i)
            pop[i] += 1
    pairs = Counter()
    for basket in likes.values():
        for a in basket:
            for b in basket:
                if a != b:
                    pairs[a, b] += 1
    scores = Counter()
    for (a, b), n in pairs.items():
        if a in history and b not in history:
            scores[b] += n / math.sqrt(pop[a] * pop[b])
    if not scores:
        scores = Counter({i: float(n) for i, n in pop.items() if i not in history})
    return sorted(((round(-s, 9), i) for i, s in scores.items() if i in items))


def scores(pairs):
    return {i: s for s, i in pairs}


def test_fit_is_the_same_for_any_chunk(spark):
    df, _ = random_inter(spark)
    tables = [sorted((r["src"], r["dst"], round(r["score"], 9)) for r in itemcf.itemcf_fit(df, chunk=c).sim.collect()) for c in (512, 3, 1)]
    assert tables[0] and tables[0] == tables[1] == tables[2]


def test_fit_of_a_user_with_thousands_of_likes(spark):
    n = 5000
    wide = spark.range(n).selectExpr("1L AS user_id", "id AS item_id", "5 AS rating", "id AS ts", "struct(5 AS rating) AS row_key")
    assert itemcf.itemcf_fit(wide).sim.count() == n * (n - 1)


@pytest.mark.parametrize("chunk", [512, 3])
def test_itemcf_matches_brute_force_for_any_chunk(spark, chunk):
    df, rows = random_inter(spark)
    model = itemcf.itemcf_fit(df, chunk=chunk)
    hist = df.filter("rating >= 4 AND user_id < 10").select("user_id", "item_id").distinct()
    users = spark.range(0, 12).withColumnRenamed("id", "user_id").union(spark.createDataFrame([(99,)], "user_id bigint"))
    got = defaultdict(list)
    for r in itemcf.itemcf_retrieve(model, hist, users, catalog(spark, 25), 50).collect():
        got[r["user_id"]].append((round(-r["score"], 9), r["item_id"]))
    seen = defaultdict(set)
    for r in hist.collect():
        seen[r["user_id"]].add(r["item_id"])
    for u in (*range(12), 99):
        want = brute_itemcf(rows, seen[u], set(range(25)))
        assert scores(got[u]) == pytest.approx(scores(want), abs=1e-8)


def test_held_out_equals_refit(spark):
    df, rows = random_inter(spark, seed=5)
    model = itemcf.itemcf_fit(df)
    hist = df.filter("rating >= 4 AND ts < 50").select("user_id", "item_id").distinct()
    users = spark.range(0, 6).withColumnRenamed("id", "user_id")
    hist = hist.join(users, "user_id", "left_semi")
    seen = defaultdict(set)
    for r in hist.collect():
        seen[r["user_id"]].add(r["item_id"])
    got = defaultdict(list)
    for r in itemcf.held_out_retrieve(model, df, hist, users, catalog(spark, 25), 50).collect():
        got[r["user_id"]].append((round(-r["score"], 8), r["item_id"]))
    for u in range(6):
        visible = [r for r in rows if r[0] != u or r[1] in seen[u]]
        want = [(round(s, 8), i) for s, i in brute_itemcf(visible, seen[u], set(range(25)))]
        assert scores(got[u]) == pytest.approx(scores(want), abs=1e-7)


def test_popularity_counts_zero_items(spark):
    df = spark.createDataFrame([(1, 2, 5, 1, 0), (2, 2, 5, 1, 1), (2, 1, 4, 1, 2)], INTER)
    users = spark.createDataFrame([(1,), (3,)], "user_id bigint")
    hist = df.filter("user_id = 1").select("user_id", "item_id")
    got = popularity.popularity_topk(df, catalog(spark, 4), users, hist, 3).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["item_id"]) for r in got] == [(1, 1), (1, 0), (1, 3), (3, 2), (3, 1), (3, 0)]


def test_hard_filter(spark):
    items = spark.createDataFrame(
        [(1, ["Sci-Fi"], 1995), (2, ["Sci-Fi"], 1999), (3, ["Sci-Fi", "Comedy"], 1999), (4, ["Sci-Fi"], None)],
        "item_id bigint, genres array<string>, year int",
    )
    states = spark.createDataFrame([(1, ["Sci-Fi"], ["Comedy"], 1990, None)],
                                   "user_id bigint, required_genres array<string>, excluded_genres array<string>, year_min int, year_max int")
    pairs = spark.createDataFrame([(1, i) for i in range(1, 5)], "user_id bigint, item_id bigint")
    blocked = spark.createDataFrame([(1, 2)], "user_id bigint, item_id bigint")
    assert [r["item_id"] for r in filters.hard_filter(pairs, items, states, blocked).collect()] == [1]
    one = filters.allowed_summary(items, states, blocked).first()
    assert (one["allowed_count"], one["allowed_id_sum"]) == (1, 1)


def test_block_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    q, it = rng.normal(size=(20, 6)), rng.normal(size=(50, 6)).round(1)
    it[10] = it[11]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "user_id bigint, weights array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(it)], "item_id bigint, weights array<double>")
    blocked = spark.createDataFrame([(0, i) for i in range(40)], "user_id bigint, item_id bigint")
    got = defaultdict(list)
    for r in dense.block_topk(queries, items, 7, blocked).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append(r["item_id"])
    for u in range(20):
        ids = [i for i in range(50) if u or i >= 40]
        assert got[u] == sorted(ids, key=lambda i: (-round(float(q[u] @ it[i]), 9), i))[:7]


def test_block_topk_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))], "user_id bigint, weights array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "item_id bigint, weights array<double>")
    rows = lambda: sorted((r["user_id"], r["rank"], r["item_id"]) for r in dense.block_topk(queries, items, 5).collect())
    whole = rows()
    monkeypatch.setattr(dense, "ITEM_BLOCK", 9)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    assert rows() == whole


def test_tfidf_needs_positive_scores(spark):
    docs = spark.createDataFrame([(1, "space war"), (2, "love story"), (3, "space love")], "item_id bigint, text string")
    vectors, idf = text.tfidf_fit(docs)
    queries = spark.createDataFrame([(7, "SPACE unknown")], "user_id bigint, text string")
    got = text.tfidf_retrieve(vectors, idf, queries, 10).orderBy("rank").collect()
    assert {r["item_id"] for r in got} == {1, 3} and all(r["score"] > 0 for r in got)


def als_rows(spark):
    rows = [(u, i, 5 if (u + i) % 3 == 0 else 2, i, u * 8 + i) for u in range(20) for i in range(8)]
    return spark.createDataFrame(rows, INTER)


def test_als_solves_its_normal_equations_and_salts_agree(spark, monkeypatch):
    df = als_rows(spark)
    factors = als.als_fit(df, rank=3, iterations=2)
    y = {r["item_id"]: np.array(r["factor"]) for r in factors.collect()}
    m = np.vstack(list(y.values()))
    hist = df.filter("rating >= 4").select("user_id", "item_id")
    got = {r["user_id"]: np.array(r["factor"]) for r in als.als_user_factors(factors, hist, 3).collect()}
    monkeypatch.setattr(als, "SALT_ROWS", 1)
    monkeypatch.setattr(als, "FAN", 2)  # sums of three salts meet in two levels
    salted = {r["user_id"]: np.array(r["factor"]) for r in als.als_user_factors(factors, hist, 3).collect()}
    for u, x in got.items():
        h = np.vstack([y[i] for i in range(8) if (u + i) % 3 == 0])
        want = np.linalg.solve(m.T @ m + 40 * h.T @ h + 0.1 * np.eye(3), 41 * h.sum(axis=0))
        assert np.allclose(x, want, atol=1e-6) and np.allclose(salted[u], want, atol=1e-6)
    again = {r["item_id"]: np.array(r["factor"]) for r in als.als_fit(df.repartition(5), rank=3, iterations=2).collect()}
    monkeypatch.undo()
    assert all(np.allclose(again[i], y[i], atol=1e-6) for i in y)


def test_als_rejects_bad_parameters(spark):
    for bad in ({"rank": 0}, {"rank": 513}, {"iterations": 0}, {"alpha": 0.0}, {"alpha": float("nan")}, {"reg": -1.0}, {"reg": float("inf")}):
        with pytest.raises(ValueError):
            als.als_fit(als_rows(spark), **bad)


def test_bpr_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(3, 2)), rng.normal(size=(4, 2))
    trip = [(0, 0, 1, 2), (1, 1, 0, 3), (2, 0, 1, 3), (3, 2, 2, 0)]

    def loss(u, v):
        a, p, n = (np.array([x for x in m]) for m in (u[[t[1] for t in trip]], v[[t[2] for t in trip]], v[[t[3] for t in trip]]))
        gap = (a * p).sum(1) - (a * n).sum(1)
        return np.log1p(np.exp(-gap)).sum() + 0.1 * sum(np.linalg.norm(x) for x in (a, p, n))

    table = lambda m, key: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], f"{key} bigint, f0 double, f1 double")
    triplets = spark.createDataFrame(trip, "draw_id bigint, user_id bigint, positive_item bigint, negative_item bigint")
    gu, gi, _ = bpr.step_gradients(triplets, table(u, "user_id"), table(v, "item_id"), 2, 0.1)
    for grad, which in ((gu, 0), (gi, 1)):
        for r in grad.collect():
            for c in range(2):
                hi, lo = [u.copy(), v.copy()], [u.copy(), v.copy()]
                hi[which][r["id"], c] += 1e-6
                lo[which][r["id"], c] -= 1e-6
                assert r[f"f{c}"] == pytest.approx((loss(*hi) - loss(*lo)) / 2e-6, abs=1e-5)


def taste_rows(spark, copies):
    """Two groups of 20 users, each liking its own half of 12 items, all users ``copies`` times."""
    rows = [(100 * c + u, i, 5, 1, i) for c in range(copies) for u in range(20) for i in range(12) if i % 2 == u % 2 and (u + i) % 5]
    return spark.createDataFrame(rows, INTER)


def likes_above_rest(users, items, df):
    """Mean score of the liked over that of the other items of a user's positives."""
    u = {r["user_id"]: np.array(r["factor"]) for r in users.collect()}
    v = {r["item_id"]: np.array(r["factor"]) for r in items.collect()}
    liked = {(r["user_id"], r["item_id"]) for r in df.collect()}
    assert set(u) == {a for a, _ in liked} and set(v) == {b for _, b in liked}
    return np.mean([u[a] @ v[b] for a, b in liked]) - np.mean([u[a] @ v[b] for a in u for b in v if (a, b) not in liked])


def test_bpr_steps_of_one_block_match_plain_steps(spark):
    df = taste_rows(spark, 1)
    users, items = bpr.bpr_fit(df, rank=2, epochs=1, lr=0.01, reg=0.1, seed=3)
    pos = df.select("user_id", "item_id")
    start = lambda key: {r[0]: np.array(r[1:]) for r in bpr._start(pos.select(key).distinct(), key, 2, 3, key[:4]).collect()}
    u, v = start("user_id"), start("item_id")
    drawn = bpr.bpr_triplets(pos, bpr.LEAST_STEPS * bpr.STEP_ROWS, 3, 0).orderBy("draw_id").collect()
    for lo in range(0, len(drawn), bpr.STEP_ROWS):
        batch = drawn[lo : lo + bpr.STEP_ROWS]
        old_u, old_v = {k: x.copy() for k, x in u.items()}, {k: x.copy() for k, x in v.items()}
        norm = lambda side, key: 0.1 / np.sqrt(sum(side[r[key]] @ side[r[key]] for r in batch))
        su, sp, sn = norm(old_u, "user_id"), norm(old_v, "positive_item"), norm(old_v, "negative_item")
        for _, a, p, n in batch:
            x, y, z = old_u[a], old_v[p], old_v[n]
            c = -1 / (1 + np.exp(x @ (y - z)))
            u[a] = u[a] - 0.01 * (c * (y - z) + su * x)
            v[p] = v[p] - 0.01 * (c * x + sp * y)
            v[n] = v[n] - 0.01 * (-c * x + sn * z)
    assert all(np.allclose(r["factor"], u[r["user_id"]], atol=1e-9) for r in users.collect())
    assert all(np.allclose(r["factor"], v[r["item_id"]], atol=1e-9) for r in items.collect())


def test_bpr_learns_the_same_from_more_blocks(spark):
    fit = lambda copies: likes_above_rest(
        *bpr.bpr_fit(taste_rows(spark, copies), rank=4, lr=0.06, epochs=1, draws_per_user=400, block_users=40), taste_rows(spark, copies))
    small, large = fit(2), fit(20)
    assert small > 0.3 and large == pytest.approx(small, rel=0.5)


def test_lightgcn_step_keeps_its_length(spark):
    fit = lambda copies: likes_above_rest(
        *graph.lightgcn_fit(taste_rows(spark, copies), rank=3, layers=1, lr=0.06, epochs=1, draws_per_user=100), taste_rows(spark, copies))
    small, large = fit(2), fit(20)
    assert small > 0 and 0 < large < 3 * small


def test_no_positives_give_empty_factors(spark):
    none = taste_rows(spark, 1).filter("rating < 4")
    for fitted in (bpr.bpr_fit(none, rank=2, epochs=1), graph.lightgcn_fit(none, rank=2, layers=1, epochs=1)):
        assert all(t.isEmpty() for t in fitted)


def test_graph_propagation_matches_matrix_power(spark):
    df = spark.createDataFrame([(0, 0, 5, 1, 0), (0, 1, 5, 1, 1), (1, 1, 5, 1, 2), (1, 1, 4, 1, 3)], INTER)
    edges = graph.normalized_edges(df)
    nodes = ["u0", "u1", "i0", "i1"]
    a = np.zeros((4, 4))
    for x, y, n in ((0, 2, 1), (0, 3, 1), (1, 3, 2)):
        a[x, y] = a[y, x] = n
    d = a.sum(1)
    a = a / np.sqrt(d[:, None] * d[None, :])
    e = np.arange(8.0).reshape(4, 2)
    emb = spark.createDataFrame([(n, *map(float, r)) for n, r in zip(nodes, e)], "node string, f0 double, f1 double")
    got = {r["node"]: (r["f0"], r["f1"]) for r in graph.graph_propagate(edges, emb, 2, 2).collect()}
    want = (e + a @ e + a @ a @ e) / 3
    assert all(got[n] == pytest.approx(tuple(w)) for n, w in zip(nodes, want))


def test_order_statistics(spark):
    values = [5.0, 1.0, 4.0, 1.0, 3.0, 2.0, 9.0]
    df = spark.createDataFrame([("m", v) for v in values], "g string, v double")
    marks = {"a": 0.0, "b": 0.5, "c": 0.95}
    ordered = sorted(values)
    near = nearest_rank(df, "v", marks, ("g",)).first()
    lin = linear_percentile(df, "v", marks, ("g",)).first()
    for k, p in marks.items():
        assert near[k] == ordered[min(len(ordered) - 1, int(p * len(ordered)))]
        assert lin[k] == pytest.approx(float(np.percentile(values, 100 * p)))
