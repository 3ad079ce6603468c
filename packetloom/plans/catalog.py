"""All registered queries."""

from packetloom.plans import queries_behavior, queries_detect, queries_packets, queries_rules, queries_stats  # noqa: F401
from packetloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
