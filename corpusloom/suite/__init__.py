"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from corpusloom.suite import (  # noqa: F401 - importing registers the queries
    aggregate_queries,
    filter_queries,
    function_queries,
    model_queries,
    plan_queries,
    sample_queries,
    source_queries,
    stream_queries,
)
from corpusloom.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
