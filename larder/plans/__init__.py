"""Queries: each is a Spark plan, most with the same question in DuckDB SQL beside it."""

from larder.plans import compositions, reads, reports, rules, state, understanding  # noqa: F401
from larder.plans.registry import ORACLES, QUERIES  # noqa: F401
