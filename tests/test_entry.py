"""The registered queries keep their contract; a fast subset is compared with its SQL."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
FAST = ["legal_train", "ranker_history", "hard_filter", "itemcf_retrieve", "fuse_minmax_linear", "fold_preferences", "group_kfold",
        "allowed_candidates", "tfidf_constrained", "ranking_constraint_check", "lambdamart_lambdas"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    message, rows, _, _ = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert message is None and rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2
