"""Queries over the driver's tables, one for each operator that can be checked there."""

from tarnwerk.plans import catalogs, distribution, scalars  # noqa: F401  they register their queries
from tarnwerk.plans.registry import ORACLES, QUERIES  # noqa: F401
