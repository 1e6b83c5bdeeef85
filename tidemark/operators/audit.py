"""Append-only event logs: audit trails and lifecycle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Ordered

# The allowed lifecycle steps.
LIFECYCLE = (("draft", "active"), ("active", "deprecated"), ("deprecated", "archived"))


def audit_trail(audit: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Each entity's events in order, with the event before. ``audit``: entity, happened_at, audit_id, event_type, actor_id."""
    before = {"previous_event": "event_type", "previous_actor": "actor_id"}
    return Ordered(audit, ["happened_at", "audit_id"], [entity]).row_number("event_number").previous(before).done()


def last_actors(audit: DataFrame, entity: str = "entity_id") -> DataFrame:
    return audit.groupBy(entity).agg(
        F.count("*").alias("events"), F.max_by("actor_id", F.struct("happened_at", "audit_id")).alias("last_actor"),
        F.max("happened_at").alias("last_at"),
    )


def invalid_transitions(log: DataFrame, entity: str = "asset_id") -> DataFrame:
    """State changes outside the lifecycle. ``log``: entity, happened_at, event_id, state; repeats of a state count."""
    ordered = Ordered(log, ["happened_at", "event_id"], [entity]).previous({"from_state": "state"})
    steps = ordered.done().where("from_state IS NOT NULL")
    allowed = F.lit(False)
    for before, after in LIFECYCLE:
        allowed = allowed | ((F.col("from_state") == before) & (F.col("state") == after))
    return steps.where(~allowed).select(entity, "event_id", "happened_at", "from_state", F.col("state").alias("to_state"))
