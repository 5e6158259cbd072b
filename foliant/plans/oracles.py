"""The registered queries and their SQL; importing this module registers them all."""

from . import case_queries, row_queries, feed_queries, inventory_queries, rule_queries, stateful_queries, sync_queries, tag_queries, tree_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
