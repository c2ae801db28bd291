"""All registered queries of the engine and their SQL."""

from seamline.plans import control_queries, graph_queries, search_queries, source_queries, text_queries, version_queries  # noqa: F401
from seamline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
