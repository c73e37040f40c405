"""Callbacks, case files and episode records."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recspark.operators import dense, episodes, ltr, text
from recspark.sources import files

CASES = [
    {"case_id": "one", "user_id": 3, "turns": ["hi", "more"], "relevant_movie_ids": [8, 9], "tags": ["t"],
     "initial_state": {"liked_movie_ids": [1], "excluded_movie_ids": [2], "liked_genres": ["Drama"], "year_min": 1990, "requested_count": 5}},
    {"case_id": "two", "user_id": 4, "turns": [], "relevant_ids": [7], "initial_state": {"liked_ids": [6]},
     "expected_preferences": {"disliked_movie_ids": [5], "ranking_mode": "novel"}},
]


@pytest.mark.parametrize("lines", [False, True])
def test_cases_by_either_name(spark, tmp_path, lines):
    path = tmp_path / "cases.json"
    path.write_text("\n".join(map(json.dumps, CASES)) if lines else json.dumps(CASES, indent=2))
    one, two = files.read_cases(spark, str(path), lines).orderBy("case_id").collect()
    assert (one["relevant_ids"], one["initial_state"]["liked_ids"], one["initial_state"]["excluded_ids"]) == ([8, 9], [1], [2])
    assert one["expected_preferences"] is None and one["initial_state"]["year_min"] == 1990
    assert (two["relevant_ids"], two["initial_state"]["liked_ids"], two["expected_preferences"]["disliked_ids"]) == ([7], [6], [5])
    files.write_cases(files.read_cases(spark, str(path), lines), str(tmp_path / "again"))
    again = files.read_cases(spark, str(tmp_path / "again"), lines=True).orderBy("case_id").collect()
    assert again == [one, two]


def test_factor_tables_keep_types(spark, tmp_path):
    factors = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0, -1.0])], "item_id bigint, factor array<double>")
    files.write_vectors(factors, str(tmp_path / "als"), rank=2, alpha=40.0, normalized=False, method="als", sweeps=[10, 12])
    back, params = files.read_vectors(spark, str(tmp_path / "als"))
    assert sorted(back.collect()) == sorted(factors.collect())
    kinds = dict(params.dtypes)
    assert (kinds["rank"], kinds["alpha"], kinds["normalized"], kinds["method"]) == ("bigint", "double", "boolean", "string")
    assert params.first().asDict() == {"rank": 2, "alpha": 40.0, "normalized": False, "method": "als", "sweeps": [10, 12]}
    files.write_vectors(factors, str(tmp_path / "bare"))
    assert files.read_vectors(spark, str(tmp_path / "bare"))[0].count() == 2


def test_episode_records_follow_the_turns(spark):
    row = lambda case, turn, traces, errors, items, ok=True: (case, turn, 1.0, 1, 2, 3, False, not ok, ok, f"s{turn}", items, traces, errors)
    turns = spark.createDataFrame([
        row("a", 2, ["c"], ["late"], [4], False), row("a", 1, ["a", "b"], None, [3]), row("b", 1, None, [], None),
    ], "case_id string, turn int, latency_ms double, model_calls int, prompt_tokens int, completion_tokens int, failed boolean, "
       "fallback_used boolean, plan_valid boolean, state string, items array<int>, traces array<string>, errors array<string>")
    a, b = episodes.episode_rollup(turns, nested=True).orderBy("case_id").collect()
    assert (a["traces"], a["errors"], a["state"], a["items"], a["steps"], a["error_count"]) == (["a", "b", "c"], ["late"], "s2", [4], 3, 1)
    assert (a["turns"], a["latency_ms"], a["fallback_used"], a["plan_valid"]) == (2, 2.0, True, False)
    assert (b["traces"], b["errors"], b["items"], b["steps"], b["error_count"]) == ([], [], None, 0, 0)
    assert "traces" not in episodes.episode_rollup(turns).columns
    steps = sorted((r["case_id"], r["turn"], r["position"], r["entry"]) for r in episodes.episode_steps(turns).collect())
    assert steps == [("a", 1, 0, "a"), ("a", 1, 1, "b"), ("a", 2, 0, "c")]
    assert episodes.episode_rollup(turns.limit(0), nested=True).count() == 0


def test_query_builder_makes_the_text(spark):
    items = spark.createDataFrame([(1, "One", 1990, ["b", "a"], "One b a"), (2, "Two", None, [], "Two"), (3, "Three", 1995, None, "Three")],
                                  "item_id bigint, title string, year int, genres array<string>, text string")
    states = spark.createDataFrame([(1, ["z", "y"]), (2, [])], "user_id bigint, liked_genres array<string>")
    hist = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (1, 1)], "user_id bigint, item_id bigint")

    def build(message, genres, liked):
        newest = F.array_join(F.transform(liked, lambda i: F.concat_ws(":", i["item_id"].cast("string"), i["title"], i["year"].cast("string"))), "|")
        return F.concat_ws("#", message, F.array_join(genres, ","), newest)

    got = {r["user_id"]: r["text"] for r in text.semantic_profile(states, hist, items, 2, build, "hello").collect()}
    assert got == {1: "hello#y,z#1:One:1990|2:Two", 2: "hello##"}
    with pytest.raises(ValueError):
        text.semantic_profile(states, hist, items, 2, "unheard-of")


def test_encoder_is_applied_before_the_norm(spark):
    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [3.0 * len(t), 4.0 * len(t)])

    rows = spark.createDataFrame([(1, "abc"), (2, "z")], "item_id bigint, text string")
    out = dense.embed_normalize(rows, encode).collect()
    assert all(r["embedding"] == pytest.approx([0.6, 0.8]) for r in out)


def test_grouped_cv_takes_another_estimator(spark):
    """A fit that scores by one column, or its negative, and a fold builder that is asked once a fold."""
    features = spark.createDataFrame([(u, i, float(i)) for u in range(6) for i in range(12)], "user_id bigint, item_id bigint, a double")
    targets = spark.createDataFrame([(u, 11) for u in range(6)], "user_id bigint, item_id bigint")
    asked, fitted = [], []

    class Column:
        def __init__(self, sign):
            self.sign = sign

        def score(self, rounds=None):
            return F.col("a") * self.sign

    def build(fold):
        asked.append(fold)
        own = F.col("user_id") % 3 == fold
        return features.filter(~own), features.filter(own), targets.filter(own)

    def fit(matrix, names, params, seed):
        fitted.append((params["num_leaves"], params["n_estimators"], tuple(names)))
        return Column(1.0 if params["num_leaves"] == 7 else -1.0)

    grid = [{"num_leaves": n, "n_estimators": e, "learning_rate": 0.1, "min_child_samples": 1} for n in (3, 7) for e in (20, 10)]
    best, rows = ltr.grouped_cv(build, ["a"], grid, 3, fit=fit)
    assert asked == [0, 1, 2] and len(fitted) == 6 and {f[1] for f in fitted} == {20}
    assert (best["num_leaves"], best["n_estimators"]) == (7, 10)
    assert [r["recall"] for r in rows] == [0.0, 0.0, 1.0, 1.0] and [r["ndcg"] for r in rows] == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        ltr.grouped_cv(build, ["a"], [], 3, fit=fit)
