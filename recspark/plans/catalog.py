"""All registered queries and their SQL."""

from recspark.plans import base_queries, eval_queries, learned_queries, route_queries, state_queries  # noqa: F401  (they register their queries)
from recspark.plans.context import QUERIES
from recspark.plans.oracle import all_sql

ORACLES = all_sql()

__all__ = ["ORACLES", "QUERIES"]
