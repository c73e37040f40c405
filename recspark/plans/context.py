"""Shared inputs of the registered queries, built once per (session, data folder)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from recspark.operators import itemcf, splits
from recspark.session import stored, tune
from recspark.sources import testdata


class Inputs:
    """Lazy DataFrames over one data folder: nothing is computed or cached here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.sf_dir, name)

    @cached_property
    def inter(self) -> DataFrame:
        return testdata.interactions(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return testdata.items(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return testdata.users(self.spark, self.sf_dir)

    @cached_property
    def constraints(self) -> DataFrame:
        return testdata.constraint_states(self.spark, self.sf_dir)

    @cached_property
    def targets(self) -> DataFrame:
        """Written once: the split, the goals and every user filter read them."""
        return stored(splits.ranking_targets(self.inter), "targets")

    @cached_property
    def legal(self) -> DataFrame:
        return splits.legal_train(self.inter, self.targets)

    @cached_property
    def legal_positives(self) -> DataFrame:
        """Positive legal rows, written once: the fit and every history read them."""
        return stored(splits.positives(self.legal), "legal")

    @cached_property
    def history(self) -> DataFrame:
        """Positive legal history rows on catalog items."""
        return splits.positive_histories(self.legal_positives, self.items)

    @cached_property
    def seen(self) -> DataFrame:
        """Written once: every route and its masks read them."""
        return stored(self.history.select("user_id", "item_id").distinct(), "seen")

    @cached_property
    def goals(self) -> DataFrame:
        """Validation target per evaluated user."""
        return self.targets.select("user_id", F.col("validation_item").alias("item_id"))

    @cached_property
    def fit_rows(self) -> DataFrame:
        """The rows that every statistic and model is fitted on."""
        return self.legal_positives

    @cached_property
    def model(self) -> itemcf.ItemCF:
        return itemcf.itemcf_stored(self.fit_rows)


class RankerInputs(Inputs):
    """What a learned ranker may see: rows before each user's ranker target, which is the goal.

    None of a user's three targets stands in any row. ``fit_users`` limits the rows that
    statistics are fitted on, ``goal_users`` the users that are asked; ``fitted`` is the
    ItemCF model of those users where it is there already."""

    def __init__(self, spark: SparkSession, sf_dir: str, fit_users: DataFrame | None = None, goal_users: DataFrame | None = None,
                 fitted: itemcf.ItemCF | None = None):
        super().__init__(spark, sf_dir)
        self.fit_users, self.goal_users, self.fitted = fit_users, goal_users, fitted

    @cached_property
    def legal(self) -> DataFrame:
        return splits.ranker_history(self.inter, self.targets)

    @cached_property
    def goals(self) -> DataFrame:
        goals = self.targets.select("user_id", F.col("ranker_item").alias("item_id"))
        return goals if self.goal_users is None else splits.restrict_users(goals, self.goal_users)

    @cached_property
    def fit_rows(self) -> DataFrame:
        if self.fit_users is None:
            return self.legal_positives
        return stored(splits.restrict_users(self.legal_positives, self.fit_users), "fit")

    @cached_property
    def model(self) -> itemcf.ItemCF:
        return super().model if self.fitted is None else self.fitted


QUERIES: dict = {}


def query(name: str):
    """Register ``fn(inputs)`` under ``name`` as ``fn(spark, sf_dir)``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query already registered: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        return fn

    return register


def longs(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(*names: str, digits: int = 6):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]
