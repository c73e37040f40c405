"""Blocked retrieval against brute force: sparse similarities, postings, masks."""

import pickle
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recspark.operators import dense, filters, itemcf, itemcf_blocks, postings, text, vector_balls
from recspark.operators.masks import BlockMasks
from recspark.operators.vector_balls import first_k
from recspark.plans.context import Inputs
from recspark.plans.route_queries import Routes
from recspark.session import work_dir

STATES = "user_id bigint, required_genres array<string>, excluded_genres array<string>, year_min int, year_max int"


def by_user(df):
    out = defaultdict(list)
    for r in df.orderBy("user_id", "rank").collect():
        out[r["user_id"]].append((r["item_id"], round(r["score"], 8)))
    return dict(out)


def sim_table(rng, n, links):
    src, dst = rng.integers(0, n, links), rng.integers(0, n, links)
    pairs = {(int(a), int(b)): float(s) for a, b, s in zip(src, dst, rng.random(links).round(2)) if a != b}
    return [(a, b, s) for (a, b), s in pairs.items()]


@pytest.mark.parametrize("links,piece", [(10**6, 10**6), (300, 40)])
def test_constrained_cells_equal_brute_force(spark, monkeypatch, links, piece):
    """Any block size gives the same rows; constraints, blocked ids and the catalog act before the k."""
    rng = np.random.default_rng(1)
    sim = sim_table(rng, 60, 900)
    pop = [(i, int(p)) for i, p in enumerate(rng.integers(1, 9, 60))]
    items = [(i, [str(g) for g in rng.choice(list("abc"), rng.integers(0, 3), replace=False)] if i % 11 else None, int(rng.integers(1990, 2000)) if i % 7 else None)
             for i in range(55)]
    hist = [(u, int(i)) for u in range(20) for i in rng.choice(60, 4, replace=False)] + [(21, 59), (21, 59)]
    blocked = [(u, int(i)) for u in range(10) for i in rng.choice(60, 10)]
    states = [(u, ["a"] if u % 3 == 0 else None, ["b"] if u % 2 else [], 1993 if u % 4 == 0 else None, 1997 if u % 5 == 0 else None) for u in range(15)]
    frame = spark.createDataFrame
    model = itemcf.ItemCF(frame(sim, "src bigint, dst bigint, score double"), frame(pop, "item_id bigint, popularity bigint"))
    item_df = frame(items, "item_id bigint, genres array<string>, year int")
    users = frame([(u,) for u in range(23)], "user_id bigint")
    state_df, blocked_df = frame(states, STATES), frame(blocked, "user_id bigint, item_id bigint")
    original = itemcf_blocks.pack
    monkeypatch.setattr(itemcf_blocks, "pack", lambda s, p, i: original(s, p, i, links, piece))
    got = by_user(itemcf.itemcf_retrieve(model, frame(hist, "user_id bigint, item_id bigint"), users, item_df, 6, state_df, blocked_df))
    pairs = users.crossJoin(item_df.select("item_id"))
    fine = {(r["user_id"], r["item_id"]) for r in filters.hard_filter(pairs, item_df, state_df, blocked_df).collect()}
    seen, popular = defaultdict(set), dict(pop)
    for u, i in hist:
        seen[u].add(i)
    for u in range(23):
        sums = defaultdict(float)
        for a, b, s in sim:
            if a in seen[u] and b not in seen[u]:
                sums[b] += s
        if not sums:
            sums = {i: float(p) for i, p in popular.items() if i not in seen[u]}
        ranked = sorted(((-round(s, 9), i) for i, s in sums.items() if (u, i) in fine))[:6]
        assert got.get(u, []) == [(i, round(-s, 8)) for s, i in ranked]


def test_masks_follow_the_row_rule(spark):
    genres = [["a", "b"], [], None, ["b"], ["a"]]
    masks = BlockMasks(genres, np.array([1990, 1995, 1995, np.nan, 2000]))
    assert masks.allowed((), (), None, None).tolist() == [True, True, False, True, True]
    assert masks.allowed(("a",), ("b",), None, None).tolist() == [False, False, False, False, True]
    assert masks.allowed((), ("x",), 1991, 1999).tolist() == [False, True, False, False, False]


def test_first_k_rounds_before_it_breaks_ties():
    scores = np.array([[0.5, 0.5 + 1e-12, -np.inf, 0.7], [-np.inf] * 4])
    row, col = first_k(scores, 2)
    assert row.tolist() == [0, 0] and col.tolist() == [3, 0]


def make_block(ids, rows):
    code, item, weight = (np.array(x) for x in zip(*sorted(rows)))
    codes, first = np.unique(code, return_index=True)
    return postings.Block({"ids": ids, "codes": codes, "ends": np.append(first, len(code)), "at": np.searchsorted(ids, item).astype(np.int32),
                           "weight": weight, "top": np.maximum.reduceat(weight, first), "years": np.full(len(ids), np.nan), "genres": [None] * len(ids)})


def asked(queries):
    pairs = pa.list_(pa.struct([("code", pa.int64()), ("weight", pa.float64())]))
    n = len(queries)
    return pa.table({
        "user_id": pa.array(range(n)), "q": pa.array([[{"code": c, "weight": w} for c, w in q.items()] for q in queries], pairs),
        "blocked": pa.array([[]] * n, pa.list_(pa.int64())), "bound": [False] * n, "required_genres": pa.array([None] * n, pa.list_(pa.string())),
        "excluded_genres": pa.array([None] * n, pa.list_(pa.string())), "year_min": pa.array([None] * n, pa.int32()), "year_max": pa.array([None] * n, pa.int32())})


def test_blocks_below_the_bound_are_skipped():
    rng = np.random.default_rng(3)
    rows = [(int(t), i, float(w)) for i in range(2000) for t, w in zip(rng.choice(300, 5, replace=False), rng.random(5) * (3 if i < 100 else 0.2))]
    blocks = [make_block(np.arange(lo, lo + 100), [r for r in rows if lo <= r[1] < lo + 100]) for lo in range(0, 2000, 100)]
    queries = [{int(t): float(w) for t, w in zip(rng.choice(300, 40, replace=False), rng.random(40) + 0.2)} for _ in range(30)]
    visits = []
    found = postings.search(blocks, asked(queries), 5, visits)
    got = defaultdict(list)
    for u, i, s in zip(*(found.column(c).to_pylist() for c in ("user_id", "item_id", "score"))):
        got[u].append((-round(s, 9), i))
    for u, q in enumerate(queries):
        sums = defaultdict(float)
        for t, i, w in rows:
            sums[i] += w * q.get(t, 0.0)
        assert sorted(got[u])[:5] == sorted((-round(s, 9), i) for i, s in sums.items() if s > 0)[:5]
    assert sum(visits) < 0.6 * 30 * len(blocks)


def test_a_million_tokens_need_no_wide_matrix():
    """Two postings a token: nothing is dense, and the block holds its postings only."""
    n = 1_000_000
    block = make_block(np.arange(1000), [(t, i % 1000, 1.0) for t in range(n) for i in (t, t * 7 + 1)])
    assert block.dense.shape == (0, 1000) and len(block.weight) == 2 * n
    found = postings.search([block], asked([{t: 1.0 for t in range(0, n, 1000)}]), 3)
    assert found.column("item_id").to_pylist()[0] == 0 and found.column("score").to_pylist()[0] == 1000.0


def test_text_route_for_any_block_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["common"] + [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, "common " + " ".join(rng.choice(words, 4)), ["g"], 1990 + i % 5) for i in range(80)],
                                 "item_id bigint, text string, genres array<string>, year int")
    queries = spark.createDataFrame([(u, " ".join(rng.choice(words, 5))) for u in range(12)], "user_id bigint, text string")
    states = spark.createDataFrame([(u, None, None, 1992, None) for u in range(6)], STATES)
    vectors, idf = text.tfidf_fit(docs)
    whole = by_user(text.tfidf_retrieve(vectors, idf, queries, 7, None, states, docs))
    original = postings.index
    monkeypatch.setattr(postings, "index", lambda r, t, i=None: original(r, t, i, block=25, group=120))
    assert by_user(text.tfidf_retrieve(vectors, idf, queries, 7, None, states, docs)) == whole and len(whole) == 12
    late = {r["item_id"] for r in docs.filter(F.col("year") >= 1992).collect()}
    assert all(i in late for u in range(6) for i, _ in whole[u])


@pytest.mark.parametrize("block", [4, 1 << 22])
def test_resample_sums_equal_single_draws(spark, block):
    """The portable draws of every resample, added up whichever block a user stands in."""
    from hashlib import md5

    from recspark.operators import metrics

    rng = np.random.default_rng(9)
    values = rng.normal(size=(11, 2))
    df = spark.createDataFrame([(j, float(a), float(b)) for j, (a, b) in enumerate(values)], "j bigint, d0 double, d1 double")
    sums = metrics.resample_sums(df, ["d0", "d1"], 11, 42, 30, block).groupBy("b").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    got = {r["b"]: (r["d0"], r["d1"]) for r in sums.collect()}
    for b in range(1, 31):
        drawn = [int(md5(f"42|{b}|{i}".encode()).hexdigest()[:8], 16) % 11 for i in range(11)]
        assert np.allclose(got[b], values[drawn].sum(axis=0))
    assert len(got) == 30


def ball_stripe(vectors, leaf):
    """One stripe of packed balls, as a cell reads it."""
    n = len(vectors)
    rows = pa.table({"ib": pa.array([0] * n, pa.int32()), "item_id": pa.array(range(n), pa.int64()),
                     "weights": pa.array([v.tolist() for v in vectors], pa.list_(pa.float64())),
                     "genres": pa.array([None] * n, pa.list_(pa.string())), "year": pa.array([None] * n, pa.int32())})
    return [pickle.loads(b.as_py()) for b in vector_balls.pack_items(rows, leaf).column("block")]


@pytest.mark.parametrize("kind", ["unit", "norms", "clusters", "equal"])
def test_balls_are_exact_and_prune(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    if kind == "norms":
        x *= np.exp(rng.normal(size=(900, 1)) * 2)
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(30, 8)), 30, axis=0) + 0.01 * x
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "equal":
        x[:] = x[0]
    q = rng.normal(size=(300, 8))
    stripe = ball_stripe(x, 32)
    assert sorted(np.concatenate([b["ids"] for b in stripe]).tolist()) == list(range(900))
    users, ids, score, share = vector_balls.search({"users": np.arange(300), "vectors": q, "profiles": [None] * 300}, stripe, 5)
    got = defaultdict(list)
    for u, i, s in zip(users, ids, score):
        got[u].append(i)
        assert abs(s - q[u] @ x[i]) < 1e-12
    for u in range(300):
        assert got[u] == sorted(range(900), key=lambda i: (-round(float(q[u] @ x[i]), 9), i))[:5]
    if kind in ("norms", "clusters"):
        assert share < 0.5


def test_vector_constraints_act_before_the_k(spark, monkeypatch):
    """Masks, blocked and allowed pairs and a null genre list, over several stripes and query blocks."""
    monkeypatch.setattr(dense, "ITEM_BLOCK", 16)
    monkeypatch.setattr(dense, "STRIPE_CELLS", 16)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(12, 3)), rng.normal(size=(80, 3))
    genres = [None if i % 11 == 0 else [g for n, g in enumerate("abc") if (i >> n) & 1] for i in range(80)]
    years = [None if i % 7 == 0 else 1980 + i for i in range(80)]
    queries = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(q)], "user_id bigint, weights array<double>")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, weights array<double>")
    catalog = spark.createDataFrame([(i, genres[i], years[i]) for i in range(78)], "item_id bigint, genres array<string>, year int")
    rules = {0: (["a"], [], None, None), 1: ([], ["b"], 1990, 2030), 2: (None, None, None, None), 3: (["a", "c"], ["b"], None, 2050)}
    states = spark.createDataFrame([(u, *r) for u, r in rules.items()],
                                   "user_id bigint, required_genres array<string>, excluded_genres array<string>, year_min int, year_max int")
    hidden = {(u, i) for u in range(12) for i in range(80) if (u * 7 + i) % 3 == 0}
    blocked = spark.createDataFrame(sorted(hidden), "user_id bigint, item_id bigint")

    def fits(u, i):
        if (u, i) in hidden:
            return False
        if u not in rules:
            return True
        own = genres[i] if i < 78 else None
        need, ban, low, high = rules[u]
        year = years[i]
        return (own is not None and set(need or []) <= set(own) and not set(ban or []) & set(own)
                and (low is None or (year is not None and year >= low)) and (high is None or (year is not None and year <= high)))

    def order(u, keep):
        return sorted((i for i in range(80) if keep(u, i)), key=lambda i: (-round(float(q[u] @ x[i]), 9), i))[:6]

    def ranked(top):
        got = defaultdict(list)
        for r in top.orderBy("user_id", "rank").collect():
            got[r["user_id"]].append(r["item_id"])
        return got

    got = ranked(dense.block_topk(queries, vectors, 6, blocked, states=states, catalog=catalog))
    assert [got[u] for u in range(12)] == [order(u, fits) for u in range(12)]
    chosen = {(u, i) for u in range(0, 12, 2) for i in range(80) if i % 5}
    allowed = spark.createDataFrame(sorted(chosen), "user_id bigint, item_id bigint")
    got = ranked(dense.block_topk(queries, vectors, 6, blocked, allowed))
    assert [got[u] for u in range(12)] == [order(u, lambda u, i: (u, i) in chosen - hidden) for u in range(12)]
    assert dense.block_topk(queries, vectors.limit(0), 6, blocked).count() == 0
    assert dense.block_topk(queries.limit(0), vectors, 6, blocked, states=states, catalog=catalog).count() == 0
    with pytest.raises(ValueError):
        dense.block_topk(queries, vectors, 6, states=states)


def test_users_meet_only_blocks_of_their_neighbours(spark, monkeypatch):
    """Separate communities: a user's rows come from the blocks of the own community, however many there are."""
    monkeypatch.setattr(itemcf_blocks, "BLOCK_USERS", 8)
    rng = np.random.default_rng(4)
    sim = [(100 * c + a, 100 * c + b, s + 0.1) for c in range(12) for a, b, s in sim_table(rng, 30, 300)]
    hist = [(10 * c + u, 100 * c + int(i)) for c in range(12) for u in range(8) for i in rng.choice(30, 3, replace=False)]
    frame = spark.createDataFrame
    ids = sorted({a for a, _, _ in sim} | {b for _, b, _ in sim})
    items = frame([(i,) for i in ids], "item_id bigint")
    packed = itemcf_blocks.pack(frame(sim, "src bigint, dst bigint, score double"), items.withColumn("popularity", F.lit(1)), items, 200, 100)
    assert packed.count >= 12
    users, seen = frame([(u,) for u in sorted({u for u, _ in hist})], "user_id bigint"), frame(hist, "user_id bigint, item_id bigint")
    got, marks = defaultdict(dict), defaultdict(int)
    for r in itemcf_blocks.cells(packed, itemcf_blocks.requests(users, seen), 40).collect():
        if r["item_id"] is None:
            marks[r["user_id"]] += 1
        else:
            got[r["user_id"]][r["item_id"]] = r["score"]
    own = defaultdict(set)
    for u, i in hist:
        own[u].add(i)
    for u, mine in own.items():
        sums = defaultdict(float)
        for a, b, s in sim:
            if a in mine and b not in mine:
                sums[b] += s
        assert 1 <= marks[u] <= 3 and got[u].keys() == sums.keys() and all(abs(got[u][i] - s) < 1e-12 for i, s in sums.items())


def test_popular_items_come_from_the_first_blocks(spark, monkeypatch):
    """Users without neighbours stop at the first block that fills their list; strict profiles go on to the last."""
    monkeypatch.setattr(itemcf_blocks, "POPULAR_ITEMS", 5)
    monkeypatch.setattr(itemcf_blocks, "POPULAR_GROWTH", 2)
    items = [(i, ["rare"] if i % 20 == 19 else ["usual"], 2000) for i in range(60)]
    pop = [(i, 1 + (i * 7) % 13) for i in range(64)]
    hist, blocked = [(u, u) for u in range(8)], [(u, 12) for u in range(6)]
    states = [(u, ["rare"] if u % 2 else [], [], None, None) for u in range(4)]
    frame, pairs = spark.createDataFrame, "user_id bigint, item_id bigint"
    item_df, pop_df = frame(items, "item_id bigint, genres array<string>, year int"), frame(pop, "item_id bigint, popularity bigint")
    asked_ = itemcf_blocks.requests(frame([(u,) for u in range(8)], "user_id bigint"), frame(hist, pairs), frame(blocked, pairs), frame(states, STATES), popular=True)
    got = defaultdict(list)
    for r in itemcf_blocks.popular_first(pop_df, item_df, asked_, 3).collect():
        got[r["user_id"]].append((-r["score"], r["item_id"]))
    for u in range(8):
        rare = u < 4 and u % 2
        want = sorted((-p, i) for i, p in pop if i < 60 and i != u and not (u < 6 and i == 12) and (not rare or i % 20 == 19))[:3]
        assert sorted(got[u])[:3] == want
        assert rare or len(got[u]) <= 6


@pytest.mark.parametrize("copies", [1, 1 << 20])
def test_items_of_one_vector_are_multiplied_once(spark, monkeypatch, copies):
    """Copies of few vectors, with blocked, allowed and constrained items, against brute force."""
    monkeypatch.setattr(dense, "COPIES", copies * 40)
    rng = np.random.default_rng(2)
    q, own = rng.normal(size=(10, 3)), rng.normal(size=(6, 3))
    own[5] = own[4]
    x = own[np.arange(150) % 6]
    frame, pairs = spark.createDataFrame, "user_id bigint, item_id bigint"
    queries = frame([(u, v.tolist()) for u, v in enumerate(q)], "user_id bigint, weights array<double>")
    vectors = frame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, weights array<double>")
    catalog = frame([(i, ["a"] if i % 4 else ["a", "b"], 1950 + i) for i in range(150)], "item_id bigint, genres array<string>, year int")
    states = frame([(u, ["b"] if u % 2 else [], [], 1960, 2090) for u in range(5)], STATES)
    hidden = {(u, i) for u in range(10) for i in range(150) if (u + i) % 5 == 0 and i < 100}
    chosen = {(u, i) for u in range(10) for i in range(150) if (u * i) % 7 < 3}
    fits = lambda u, i: u >= 5 or ((i % 4 == 0 or u % 2 == 0) and 1960 <= 1950 + i <= 2090)
    for k in (4, 30):
        for restricted in (False, True):
            top = dense.block_topk(queries, vectors, k, frame(sorted(hidden), pairs), frame(sorted(chosen), pairs) if restricted else None, states, catalog)
            got = defaultdict(list)
            for r in top.orderBy("user_id", "rank").collect():
                got[r["user_id"]].append(r["item_id"])
            for u in range(10):
                may = [i for i in range(150) if fits(u, i) and (u, i) not in hidden and (not restricted or (u, i) in chosen)]
                assert got[u] == sorted(may, key=lambda i: (-round(float(q[u] @ x[i]), 9), i))[:k]


def test_a_ball_holds_each_vector_once():
    rows = pa.table({"ib": pa.array([0, 0], pa.int32()), "weights": pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float64())),
                     "members": pa.array([[{"item_id": i, "genres": None, "year": None} for i in range(n, 1000, 2)] for n in (1, 0)],
                                         pa.list_(pa.struct([("item_id", pa.int64()), ("genres", pa.list_(pa.string())), ("year", pa.int32())])))})
    stripe = [pickle.loads(b.as_py()) for b in vector_balls.pack_items(rows, 64).column("block")]
    assert [b["vectors"].shape for b in stripe] == [(2, 2)] and len(stripe[0]["ids"]) == 1000
    _, ids, _, _ = vector_balls.search({"users": np.arange(1), "vectors": np.array([[1.0, 0.5]]), "profiles": [None]}, stripe, 3)
    assert ids.tolist() == [1, 3, 5]


@pytest.mark.parametrize("bound", [False, True])
def test_items_of_one_text_are_one_vector(spark, monkeypatch, bound):
    """The index holds each distinct text's postings once; copies are ranked by id, seen and constrained ones leave."""
    texts = ["red ring", "red bolt", "blue ring big", "green nut"]
    docs = [(i, texts[i % 4], ["g"] if i % 3 else ["h"], 1990 + i % 7) for i in range(200)]
    docs_df = spark.createDataFrame(docs, "item_id bigint, text string, genres array<string>, year int")
    queries = spark.createDataFrame([(u, ["red", "ring big", "bolt nut"][u % 3]) for u in range(9)], "user_id bigint, text string")
    gone = [(u, i) for u in range(9) for i in range(200) if (u * 7 + i) % 5 == 0]
    states = spark.createDataFrame([(u, None, ["h"], 1992, None) for u in range(0, 9, 2)], STATES) if bound else None
    vectors, idf = text.tfidf_fit(docs_df)
    made = postings.index(vectors, "item_id")
    sizes = [len(pickle.loads(r["block"])["at"]) for r in made.blocks.collect()]
    assert sum(sizes) == 9  # 2 + 2 + 3 + 2 postings for 200 items
    got = by_user(text.tfidf_retrieve(vectors, idf, queries, 60, spark.createDataFrame(gone, "user_id bigint, item_id bigint"), states, docs_df))
    weights = {r["item_id"]: dict(zip(r["tokens"], r["weights"])) for r in vectors.collect()}
    asked_ = {r["user_id"]: dict(zip(r["tokens"], r["weights"])) for r in text.vectorize(text.counted(queries, "user_id"), idf, "user_id").collect()}
    for u in range(9):
        fine = [i for i, _, g, y in docs if (u, i) not in set(gone) and not (bound and u % 2 == 0 and (g == ["h"] or y < 1992))]
        score = {i: sum(w * asked_[u].get(t, 0.0) for t, w in weights[i].items()) for i in fine}
        want = sorted(((-round(s, 9), i) for i, s in score.items() if s > 0))[:60]
        assert [i for i, _ in got[u]] == [i for _, i in want]


def test_texts_of_one_key_are_counted_together(spark):
    """Rows of one id make one vector, whichever chunk or batch they stand in; a text without tokens has none."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (1, "a c A"), (3, None), (4, "--")], "item_id bigint, text string")
    counts = {r["item_id"]: dict(zip(r["tokens"], r["tfs"])) for r in text.counted(docs, "item_id").collect()}
    assert counts == {1: {"a": 3, "b": 1, "c": 1}, 2: {"b": 1, "c": 1}}
    _, idf = text.tfidf_fit(docs)
    assert {r["token"]: round(r["idf"], 9) for r in idf.collect()} == {
        t: round(float(np.log(6 / (1 + n)) + 1), 9) for t, n in (("a", 1), ("b", 2), ("c", 2))}


def test_tokens_that_nobody_asks_for_are_not_indexed(spark):
    docs = spark.createDataFrame([(i, f"common word{i} other{i}") for i in range(50)], "item_id bigint, text string")
    vectors, idf = text.tfidf_fit(docs)
    counts = text.counted(spark.createDataFrame([(1, "word7 common")], "user_id bigint, text string"), "user_id")
    left = {r["item_id"]: dict(zip(r["tokens"], r["weights"])) for r in text.asked_only(vectors, counts).collect()}
    whole = {r["item_id"]: dict(zip(r["tokens"], r["weights"])) for r in vectors.collect()}
    assert len(left) == 50 and sum(len(v) for v in left.values()) < 60
    assert left[7]["word7"] == whole[7]["word7"] and all(left[i]["common"] == whole[i]["common"] for i in range(50))


def test_a_shuffle_is_read_in_bounded_pieces(spark):
    """Tasks behind a shuffle follow its bytes: a session of two partitions does not read it in two tasks."""
    from recspark.session import tune

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = tune(spark).range(2_000_000).groupBy((F.col("id") * 7).alias("k")).agg(F.sum(F.xxhash64("id")).alias("s"))
        assert rows.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_routes_keep_only_their_results(spark, tmp_path):
    """No block, request or shuffle outlives a route, and a pair of items is stored once."""
    x = Inputs(spark, "/root/testdata/sf0.001")
    made = itemcf.itemcf_retrieve(x.model, x.seen, x.goals, x.items, 20)
    assert made.count() > 0
    (pairs,) = {f.rsplit("/", 1)[0] for f in x.model.sim.inputFiles() if "/pairs-" in f}
    assert 2 * spark.read.parquet(pairs).count() == x.model.sim.count()
    left = {p.name.rsplit("-", 1)[0] for p in Path(work_dir(spark).removeprefix("file:")).iterdir()}
    before = {p.name for p in Path(work_dir(spark).removeprefix("file:")).iterdir()}
    itemcf.itemcf_retrieve(x.model, x.seen, x.goals, x.items, 20)
    new = {p.name.rsplit("-", 1)[0] for p in Path(work_dir(spark).removeprefix("file:")).iterdir() if p.name not in before}
    assert new <= {"neighbours", "lonely", "cells"} and "neighbours" in left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    routes = Routes(x, 20)
    assert routes.itemcf() is routes.itemcf() and routes.semantic() is routes.semantic()


def test_links_are_bundled_for_the_shuffle(monkeypatch):
    monkeypatch.setattr(itemcf_blocks, "BUNDLE_LINKS", 50)
    rng = np.random.default_rng(3)
    batches = [pa.RecordBatch.from_pydict({"ib": pa.array(rng.integers(0, 3, n), pa.int32()), "part": pa.array(rng.integers(0, 2, n), pa.int32()),
                                           "src": rng.integers(0, 9, n), "dst": rng.integers(0, 9, n), "score": rng.random(n)}) for n in (40, 0, 40, 7)]
    rows = lambda b: list(zip(*(b.column(c).to_pylist() for c in ("ib", "part", "src", "dst", "score"))))
    got = []
    for batch in itemcf_blocks.bundled(iter(batches)):
        for ib, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            links = itemcf_blocks.unpacked(blob)
            got += [(ib, part, *row) for row in zip(*(links[c].tolist() for c in ("src", "dst", "score")))]
    assert sorted(got) == sorted(r for b in batches for r in rows(b))
