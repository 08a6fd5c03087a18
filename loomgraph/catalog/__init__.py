"""All named queries. Importing this package registers them."""

from loomgraph.catalog import evidence_queries, extract_queries, flow_queries, graph_queries, io_queries, plan_queries, reconcile_queries  # noqa: F401
from loomgraph.catalog.registry import ORACLE, QUERIES  # noqa: F401
