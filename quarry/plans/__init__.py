"""Registered queries over the given tables (one per inventory item)."""

from .registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every query module so its queries register."""
    from . import (cluster_queries, eda_queries, learner_queries, linear_queries, model_queries,  # noqa: F401
                   prep_queries,
                   stats_queries)
