"""All queries. Importing a module registers what it defines."""

from tablewright.plans import (  # noqa: F401
    aggregates,
    build,
    joins,
    scalars,
    sets,
    statements,
    storage,
    user_functions,
    windows,
)
from tablewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
