"""Registered queries and their SQL."""

from chronoweave.plans import coref, files, gates, graph, helpers, learning, ranking, statistics, text  # noqa: F401
from chronoweave.plans.registry import ORACLE, QUERIES  # noqa: F401
