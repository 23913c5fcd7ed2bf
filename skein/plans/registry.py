"""All queries over the engine's own operators."""

from skein.plans import code_plans, deep_plans, more_plans, search_plans, state_plans, table_plans  # noqa: F401
from skein.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
