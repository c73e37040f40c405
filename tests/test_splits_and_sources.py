import random

import pytest
from pyspark.sql import functions as F

from recspark.operators import cohorts, splits
from recspark.sources.files import read_interactions, read_items

INTER = "user_id bigint, item_id bigint, rating int, ts bigint, row_key int"


def inter(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], INTER)


def test_text_sources(spark, tmp_path):
    catalog, log = tmp_path / "catalog.txt", tmp_path / "log.txt"
    catalog.write_bytes("31::Die Brücke (II) (1959)::War\n\n8::Untitled (12)::Short|Sport|War\n40::Año 2000 (1987) ::\n".encode("latin-1"))
    log.write_text("\n3::40::1::0\n3::8::5::4102444800\n")
    rows = {r["item_id"]: (r["title"], r["year"], r["genres"]) for r in read_items(spark, str(catalog)).filter("item_id IS NOT NULL").collect()}
    assert rows[31] == ("Die Brücke (II) (1959)", 1959, ["War"])
    assert rows[8] == ("Untitled (12)", None, ["Short", "Sport", "War"])
    assert rows[40][1] == 1987
    got = read_interactions(spark, str(log)).orderBy("ts").collect()
    assert [(r["user_id"], r["item_id"], r["rating"], r["ts"]) for r in got] == [(3, 40, 1, 0), (3, 8, 5, 4102444800)]


def test_malformed_ratings_fail(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("7::x::2::200\n")
    with pytest.raises(Exception):
        read_interactions(spark, str(tmp_path / "ratings.dat")).collect()


def random_log(seed, users=40, rows=260, items=9):
    """Rows with repeated items, tied times and users of all sizes."""
    rng = random.Random(seed)
    return [(int(users * rng.random() ** 2), rng.randrange(items), rng.randint(1, 5), rng.randrange(40)) for _ in range(rows)]


def liked(rows, user):
    """A user's positive rows in time, ties by item and place in the log."""
    return sorted((t, i, n) for n, (u, i, r, t) in enumerate(rows) if u == user and r >= 4)


@pytest.mark.parametrize("seed", [0, 1])
def test_chronological_split_row_by_row(spark, seed):
    log = random_log(seed)
    train, targets = splits.chronological_split(inter(spark, log))
    held, want = set(), []
    for u in {row[0] for row in log}:
        own = liked(log, u)
        if len(own) > 2:
            held |= {n for *_, n in own[-2:]}
            want.append((u, own[-2][1], own[-1][1]))
    assert sorted(r["row_key"] for r in train.collect()) == sorted(set(range(len(log))) - held)
    assert sorted(tuple(r) for r in targets.collect()) == sorted(want) and 0 < len(want) < len({row[0] for row in log})


@pytest.mark.parametrize("seed", [2, 3])
def test_leakage_safe_split_row_by_row(spark, seed):
    log = random_log(seed)
    targets, history, legal = splits.leakage_safe_split(inter(spark, log))
    want, before, allowed = {}, [], []
    for u in {row[0] for row in log}:
        last = {}
        for n, (v, i, r, t) in enumerate(log):
            if v == u and r >= 4:
                last[i] = max(last.get(i, (-1, -1)), (t, r))
        order = sorted(last, key=lambda i: (last[i][0], i, last[i][1]))
        if len(order) > 2:
            want[u] = order[-3:]
    assert {r["user_id"]: [r["ranker_item"], r["validation_item"], r["test_item"]] for r in targets.collect()} == want
    for name, rows in (("history", history), ("legal", legal)):
        for u, own in want.items():
            got = {r["item_id"] for r in rows.filter(F.col("user_id") == u).collect()}
            gone = set(own) if name == "history" else set(own[1:])
            assert not got & gone, name
            # What was before the ranker target in time and is no target stays.
            start = max(t for v, i, r, t in log if v == u and i == own[0] and r >= 4)
            assert {i for v, i, _, t in log if v == u and t < start} - set(own) <= got, name


def test_group_kfold_is_reversed_round_robin(spark):
    users = spark.range(1, 8).withColumnRenamed("id", "user_id")
    folds = {r["user_id"]: r["fold"] for r in splits.group_kfold(users, 3).collect()}
    assert folds == {7: 0, 6: 1, 5: 2, 4: 0, 3: 1, 2: 2, 1: 0}


def test_cohorts_are_disjoint_and_sized(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "user_id bigint")
    sizes = {"development": 4, "confirmation_a": 5, "confirmation_b": 5}
    rows = cohorts.cohort_ledger(ids(*range(1, 21)), ids(1, 2, 3, 4, 5), ids(9), sizes, 42).collect()
    assert len(rows) == len({r["user_id"] for r in rows}) == 14
    assert not {r["user_id"] for r in rows} & {1, 2, 3, 4, 5, 9}
    count = lambda c: sum(r["cohort"] == c for r in rows)
    assert [count(c) for c in cohorts.COHORTS] == [4, 5, 5]
    with pytest.raises(ValueError):
        cohorts.cohort_ledger(ids(1, 2), ids(1), ids(2), sizes, 42)


def test_fingerprint_ignores_order_but_not_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    value = lambda df: cohorts.table_fingerprint(df, ["k", "v"]).first()["fingerprint"]
    assert value(a) == value(b) != value(a.union(a))
