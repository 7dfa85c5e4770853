"""All queries of the library."""

from tapeloom.plans import bar_queries, context_queries, graph_queries, io_queries, signal_queries  # noqa: F401
from tapeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
