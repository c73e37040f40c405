"""What a step works on is bounded: cases by their number, tasks by their pairs."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recspark.functions.portable import draw, draws_of
from recspark.operators import bpr, cases, dense, itemcf, itemcf_blocks, vector_balls
from recspark.session import tune


def test_cases_rank_the_genres_of_drawn_users_only(spark, monkeypatch):
    genres = [["a", "b"], ["b", "c"], ["a", "c"], ["c"]]
    items = spark.createDataFrame(list(enumerate(genres)), "item_id bigint, genres array<string>")
    train = spark.createDataFrame([(u, u % 4, 5, u, u) for u in range(400)], "user_id bigint, item_id bigint, rating int, ts bigint, row_key bigint")
    targets = spark.createDataFrame([(u, (u // 4) % 4) for u in range(400)], "user_id bigint, test_item bigint")
    original, asked = cases.favorite_genres, []
    monkeypatch.setattr(cases, "favorite_genres", lambda h, i: asked.append(h.select("user_id").distinct().count()) or original(h, i))
    rows = cases.generate_cases(items, train, targets, 5, 3, 42).collect()
    assert asked and max(asked) < 400  # the whole table before
    order = cases.draw(42, F.col("user_id"))
    users = [r["user_id"] for r in targets.orderBy(order, "user_id").collect()]
    single = {r["case_id"]: r["user_id"] for r in rows if r["kind"] == "single-turn"}
    assert [single[c] for c in sorted(single)] == users[:5]
    want = []
    for u in users[5:] + users[:5]:
        left = [g for g in "abc" if g != min(genres[u % 4]) and g not in genres[(u // 4) % 4]]
        want += [(u, min(genres[u % 4]), left[0])] if left else []
    multi = {r["case_id"]: (r["user_id"], r["liked_genres"][0], r["excluded_genre"]) for r in rows if r["kind"] == "multi-turn"}
    assert [multi[c] for c in sorted(multi)] == want[:3]


def test_co_likes_are_dealt_by_pairs(spark, monkeypatch):
    likes = spark.createDataFrame([(u, u % 3 + i) for u in range(60) for i in range(20)], "user_id bigint, item_id bigint")
    whole = itemcf.co_likes(likes, 7)
    monkeypatch.setattr(itemcf, "TASK_PAIRS", 500)
    dealt = itemcf.co_likes(likes, 7)
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == -(-60 * 190 // 500)
    counted = lambda df: {(r["a"], r["b"]): r["count"] for r in df.groupBy("a", "b").count().collect()}
    assert counted(whole) == counted(dealt) and sum(counted(dealt).values()) == 60 * 190


def test_negatives_are_drawn_again_only_for_positives(monkeypatch):
    asked = []
    monkeypatch.setattr(bpr, "draws_of", lambda ids, *before, after=(): asked.append(len(ids)) or draws_of(ids, *before, after=after))
    likes = pa.table({"u": [1, 1, 2], "i": [1, 3, 2], "n": [2, 1, 1]})
    u = np.arange(4000) % 2 + 1
    at, negative = bpr.drawn_items(np.arange(4000), u, likes, 40, 7, 0)
    assert asked[:2] == [4000, 4000] and sum(asked[2:]) < 400  # six tries for every draw before
    assert set(at[u == 1]) == {0, 1} and set(at[u == 2]) == {2}
    assert 0.6 < np.mean(at[u == 1] == 0) < 0.73  # two of three rows of the user
    assert not set(zip(u, negative)) & {(1, 1), (1, 3), (2, 2)} and set(negative) == set(range(1, 41))


def test_draws_and_slices_equal_the_column(spark, monkeypatch):
    ids = [0, 1, 12345678901]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select(draw(42, 3, "negative", F.col("id"), 2).alias("d")).collect()
    assert [r["d"] for r in rows] == draws_of(np.array(ids), 42, 3, "negative", after=(2,)).tolist()
    pos = spark.createDataFrame([(u, i) for u in range(30) for i in range(20) if (u + i) % 3], "user_id bigint, item_id bigint")
    whole = {tuple(r) for r in bpr.bpr_triplets(pos, 500, 5, 1).collect()}
    monkeypatch.setattr(bpr, "SLICE_DRAWS", 100)
    assert len(whole) == 500 and {tuple(r) for r in bpr.bpr_triplets(pos, 500, 5, 1).collect()} == whole


def test_balls_are_made_from_bounded_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # Half of the vectors agree in the first coordinate.
    items = [(i, [0.5 if i % 2 else float(v[0]), *map(float, v[1:])]) for i, v in enumerate(rng.normal(size=(900, 3)))]
    users = [(u, list(map(float, v))) for u, v in enumerate(rng.normal(size=(20, 3)))]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, weights array<double>")
    monkeypatch.setattr(dense, "PIECE", 64)
    sizes = dense.pieces(table(items, "item_id"), 900).groupBy("range", "piece").count().collect()
    assert max(r["count"] for r in sizes) <= 128 and sum(r["count"] for r in sizes) == 900  # one group of a stripe before
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in dense.block_topk(table(users, "user_id"), table(items, "item_id"), 5).collect()}
    for u, q in users:
        order = sorted(items, key=lambda r: (-round(float(np.dot(q, r[1])), 9), r[0]))
        assert [got[u, n] for n in range(1, 6)] == [i for i, _ in order[:5]]


def test_scans_read_bounded_pieces(spark, tmp_path):
    tune(spark).range(0, 40, 1, 40).write.parquet(str(tmp_path / "t"))
    # A file counts as 4 MB at least: before, the cores shared 160 MB, 5 files a task and more in larger tables.
    assert spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() >= 20


def test_queries_meet_shared_vectors_together(monkeypatch):
    """No Python step per (query, ball) where vectors have several items, and the same first k."""
    rng = np.random.default_rng(4)
    own = rng.normal(size=(40, 3))
    members = pa.list_(pa.struct([("item_id", pa.int64()), ("genres", pa.list_(pa.string())), ("year", pa.int32())]))
    lists = [[{"item_id": i, "genres": ["a"] if i % 3 else ["b"], "year": 1950 + i % 50} for i in range(v, 400, 40)] for v in range(40)]
    rows = pa.table({"ib": pa.array([0] * 40, pa.int32()), "weights": pa.array(own.tolist(), pa.list_(pa.float64())), "members": pa.array(lists, members)})
    stripe = [pickle.loads(b.as_py()) for b in vector_balls.pack_items(rows, 8).column("block")]
    assert len(stripe) > 1
    monkeypatch.setattr(vector_balls, "copies", lambda *a: pytest.fail("a step per query"))
    q = rng.normal(size=(300, 3))
    blocked = [(u, i) for u in range(300) for i in rng.choice(400, u % 30, replace=False).tolist()]
    pairs = pa.table({"user_id": [u for u, _ in blocked], "item_id": [i for _, i in blocked], "keep": [False] * len(blocked)})
    marks = vector_balls._marks(np.arange(300), stripe, pairs)
    profiles = [((), ("b",), 1960, None) if u % 2 else None for u in range(300)]
    users, ids, score, _ = vector_balls.search({"users": np.arange(300), "vectors": q, "profiles": profiles}, stripe, 25, marks)
    shut, got = set(blocked), {}
    for u, i in zip(users.tolist(), ids.tolist()):
        got.setdefault(u, []).append(i)
    for u in range(300):
        may = [i for i in range(400) if (u, i) not in shut and (u % 2 == 0 or i % 3 and i % 50 >= 10)]
        assert got[u] == sorted(may, key=lambda i: (-round(float(q[u] @ own[i % 40]), 9), i))[:25]


def test_a_cell_with_all_items_ranks_its_users(spark, monkeypatch):
    """One stripe needs no shuffle of its rows; a user with two queries still has k rows."""
    monkeypatch.setattr(dense, "top_k", lambda *a: pytest.fail("ranked again"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "user_id bigint, weights array<double>")
    items = spark.createDataFrame([(i, [float(i), 3.5 - i]) for i in range(6)], "item_id bigint, weights array<double>")
    got = sorted(tuple(r) for r in dense.block_topk(queries, items, 3).collect())
    assert got == [(1, 0, 3.5, 3), (1, 4, 4.0, 2), (1, 5, 5.0, 1), (2, 0, 3.5, 1), (2, 1, 3.5, 2), (2, 2, 3.5, 3)]


def test_means_are_added_up_in_bounded_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 4))
    pairs = [(int(u), int(i)) for u, i in zip(rng.integers(0, 5, 300), rng.integers(0, 50, 300))] + [(9, 3)] * 200
    monkeypatch.setattr(dense, "KEY_ROWS", 40)
    got = dense.mean_vector(spark.createDataFrame(pairs, "user_id bigint, item_id bigint"), spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "item_id bigint, embedding array<double>")).collect()
    assert len(got) == 6
    for r in got:
        want = np.mean([vectors[i] for u, i in pairs if u == r["user_id"]], axis=0)
        assert np.allclose(r["embedding"], want / np.linalg.norm(want))


def test_a_cell_joins_its_pieces_and_keeps_only_what_may_be_in_the_first_k():
    pieces = [{"sources": np.array([4, 9]), "ends": np.array([0, 2, 3]), "at": np.array([0, 2, 1], np.int32), "score": np.array([0.5, 0.25, 1.0])},
              {"sources": np.array([2]), "ends": np.array([0, 2]), "at": np.array([1, 2], np.int32), "score": np.array([2.0, 4.0])}]
    links = itemcf_blocks.joined(pieces)
    assert links["sources"].tolist() == [2, 4, 9] and links["lengths"].tolist() == [2, 2, 1]
    sums = itemcf_blocks._sums(links, 3, np.array([0, 0, 1]), np.array([2, 4, 9]), 2)
    assert sums.tolist() == [[0.5, 2.0, 4.25], [0.0, 1.0, 0.0]]
    met, ends = itemcf_blocks._positive(sums)
    assert met.tolist() == [0, 1, 2, 4] and ends.tolist() == [0, 3, 4]
    assert vector_balls.within_k(sums.ravel()[met], ends, 2).tolist() == [False, True, True, True]
