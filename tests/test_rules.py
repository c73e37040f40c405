"""Rules that hold for odd inputs: null constraints, foreign targets, colliding texts, broken patches."""

import pytest
from pyspark.sql import functions as F

from recspark.operators import candidates, cohorts, filters, ltr, metrics, splits, state
from recspark.plans.context import Inputs, RankerInputs

STATE = "user_id long, required_genres array<string>, excluded_genres array<string>, year_min int, year_max int"


def items(spark):
    return spark.createDataFrame([(1, ["a"], 1980), (2, ["b"], 1995), (3, ["b", "x"], 2001), (4, ["a"], None)], "item_id long, genres array<string>, year int")


def test_null_lists_keep_the_other_constraints(spark):
    states = spark.createDataFrame([(1, None, ["x"], 1990, None), (2, None, None, None, None)], STATE)
    pairs = spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in (1, 2, 3)], "user_id long, item_id long")
    kept = filters.hard_filter(pairs, items(spark), states).collect()
    assert sorted(map(tuple, kept)) == [(1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    blocked = pairs.limit(0)
    sizes = {r["user_id"]: r["allowed_count"] for r in filters.allowed_summary(items(spark), states, blocked).collect()}
    assert sizes == {1: 1, 2: 4}
    audit = filters.constraint_audit(pairs, items(spark), states, blocked).collect()
    assert {r["user_id"]: r["constraint_satisfied"] for r in audit} == {1: False, 2: True, 3: True}


def test_target_outside_the_catalog_is_no_candidate(spark):
    ranked = spark.createDataFrame([(1, 1, 1)], "user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(1, 99), (2, 1), (3, 2)], "user_id long, item_id long")
    hist = spark.createDataFrame([(3, 2)], "user_id long, item_id long")
    out = metrics.score_ranking(ranked, targets, hist, items(spark)).collect()
    assert {r["user_id"]: r["candidate_recall"] for r in out} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_fingerprints_tell_separators_and_nulls(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ('a","c1":"b', "c")]
    prints = {cohorts.table_fingerprint(spark.createDataFrame([r], "x string, y string"), ["x", "y"]).first()["fingerprint"] for r in rows}
    assert len(prints) == len(rows)


PATCH = ("session_id long, turn int, replace_soft boolean, liked_ids array<long>, disliked_ids array<long>, excluded_ids array<long>, "
         "required_genres array<string>, excluded_genres array<string>, liked_genres array<string>, disliked_genres array<string>, "
         "year_min int, year_max int, requested_count int, ranking_mode string")


def patches(spark, scalars):
    return spark.createDataFrame([(1, t, False, [], [], [], [], [], [], [], *s, None) for t, s in enumerate(scalars)], PATCH)


@pytest.mark.parametrize("scalars, message", [
    ([(2000, None, None), (None, 1990, None), (1980, None, None)], "year_min"),
    ([(None, None, 500), (None, None, 5)], "requested_count"),
])
def test_every_patch_is_validated(spark, scalars, message):
    with pytest.raises(Exception, match=message):
        state.fold_preferences(patches(spark, scalars)).collect()


def test_valid_patches_pass(spark):
    out = state.fold_preferences(patches(spark, [(1980, None, 100), (None, 1990, None), (1985, None, 1)])).collect()
    assert {r["field"]: r["value"] for r in out} == {"year_min": "1985", "year_max": "1990", "requested_count": "1", "ranking_mode": "balanced"}


def test_disliked_tastes_reach_the_features(spark):
    union = spark.createDataFrame([(1, 2, 1.0, 1, True, 0.0, None, False)], "user_id long, item_id long, itemcf_score double, itemcf_rank int, in_itemcf boolean, "
                                  "dense_score double, dense_rank int, in_dense boolean")
    hist = spark.createDataFrame([(1, 1, 5)], "user_id long, item_id long, rating int")
    tastes = spark.createDataFrame([(1, ["a"], ["b"])], "user_id long, liked_genres array<string>, disliked_genres array<string>")
    marks = spark.createDataFrame([(1, 2, True, False)], "user_id long, item_id long, liked boolean, disliked boolean")
    value = lambda **o: candidates.candidate_features(union, items(spark), hist, hist, tastes, **o).first()["preference_affinity"]
    assert value() == 0.0 and value(marks=marks) == 0.5


def test_ranker_rows_hold_no_target(spark):
    x = RankerInputs(spark, "/root/testdata/sf0.001")
    hidden = x.targets.selectExpr("user_id", "explode(array(ranker_item, validation_item, test_item)) AS item_id")
    assert hidden.count() > 0
    assert x.fit_rows.join(hidden, ["user_id", "item_id"], "left_semi").isEmpty()
    asked = Inputs(spark, x.sf_dir).goals
    assert x.goals.join(asked, ["user_id", "item_id"], "left_semi").isEmpty()


def test_folds_fit_on_training_users_alone(spark):
    folds = splits.group_kfold(RankerInputs(spark, "/root/testdata/sf0.001").goals, 3)
    train, held = folds.filter("fold <> 0"), folds.filter("fold = 0")
    x = RankerInputs(spark, "/root/testdata/sf0.001", train, held)
    assert not x.goals.isEmpty() and x.goals.join(train, "user_id", "left_semi").isEmpty()
    assert x.fit_rows.join(held, "user_id", "left_semi").isEmpty()
    # The held-out users' own history still asks for candidates.
    assert not x.history.join(held, "user_id", "left_semi").isEmpty()
    counted = {r["item_id"]: r["n"] for r in x.fit_rows.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    own = RankerInputs(spark, x.sf_dir, train, train)
    assert counted == {r["item_id"]: r["n"] for r in own.fit_rows.groupBy("item_id").agg(F.count("*").alias("n")).collect()}


def test_simpler_setting_wins_ties(spark):
    base = {"num_leaves": 15, "learning_rate": 0.1, "n_estimators": 100, "min_child_samples": 20}
    row = lambda ndcg, recall, **p: {"ndcg": ndcg, "recall": recall, "params": {**base, **p}}
    best = lambda *rows: ltr.choose_setting(spark, rows)
    assert best(row(0.2, 0.1), row(0.3, 0.0, num_leaves=31))["num_leaves"] == 31
    assert best(row(0.3, 0.1), row(0.3 + 1e-14, 0.2, num_leaves=31))["num_leaves"] == 31
    assert best(row(0.3, 0.1, n_estimators=200), row(0.3, 0.1))["n_estimators"] == 100
    assert best(row(0.3, 0.1), row(0.3, 0.1, min_child_samples=50))["min_child_samples"] == 50
