"""All registered queries."""

from tidemark.plans import (  # noqa: F401  registers their queries
    discovery, discovery_runs, drifting, ingestion, operations, quality, tracing,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
