"""Registered queries: discovery runs from snapshot to totals, and approvals bound to runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import approvals, drift
from tidemark.operators.discovery import discover_runs
from tidemark.plans.discovery import _SNAPSHOT_TYPE
from tidemark.plans.drifting import _ALL, _CRITICAL
from tidemark.plans.registry import Inputs, query

# An asset is a user, an object one of its event types; assets divisible by five were never discovered before.
_ASSET = "split_part(object_id, '_', 2)"
_FIRST_TIME = f"CAST({_ASSET} AS INTEGER) % 5 = 0"


def _asset() -> F.Column:
    return F.split_part("object_id", F.lit("_"), F.lit(2))


def _captured(fields: DataFrame, run: str) -> DataFrame:
    return fields.withColumns({"asset_id": _asset(), "run_id": F.concat(F.lit(run), _asset())})


_LISTS = """
    SELECT object_id, list(struct_pack(name := name, s := source_type, t := normalized_type, n := nullable, k := is_primary_key,
                                       d := coalesce(description, '')) ORDER BY ordinal) AS listed FROM {%s} GROUP BY object_id"""


@query("discovery_run", f"""
    WITH b AS (SELECT * FROM {{fields_before}} WHERE NOT ({_FIRST_TIME})
               AND {_ASSET} IN (SELECT {_ASSET} FROM {{fields_after}})),
         e AS (SELECT * FROM ({_ALL}) WHERE {_ASSET} IN (SELECT {_ASSET} FROM {{fields_after}})
               AND (NOT ({_FIRST_TIME}) )),
         added AS (SELECT DISTINCT object_id, 'object_added' AS change_type FROM {{fields_after}} WHERE {_FIRST_TIME}),
         events AS (SELECT object_id, change_type FROM e WHERE change_type <> 'object_removed' UNION ALL SELECT * FROM added),
         healed AS (SELECT DISTINCT object_id FROM events WHERE change_type NOT IN {_CRITICAL}),
         snap AS (SELECT *, {_SNAPSHOT_TYPE} AS new_type FROM {{fields_after}} WHERE object_id IN (SELECT object_id FROM healed)),
         merged AS (SELECT s.object_id,
                           CASE WHEN c.object_id IS NULL THEN 'added'
                                WHEN c.destination_type = s.new_type AND c.nullable = s.nullable THEN 'kept'
                                WHEN c.source_type = 'string' AND s.new_type IN ('integer', 'bigint', 'float', 'date', 'timestamp', 'boolean')
                                THEN 'refused' ELSE 'updated' END AS action
                    FROM snap s LEFT JOIN {{contract}} c ON c.object_id = s.object_id AND c.name = s.name),
         changed AS (SELECT a.object_id FROM ({_LISTS % 'fields_after'}) a LEFT JOIN ({_LISTS % 'fields_before'}) p
                     ON p.object_id = a.object_id AND NOT ({_FIRST_TIME.replace('object_id', 'a.object_id')})
                     WHERE p.object_id IS NULL OR p.listed <> a.listed),
         per AS (
           SELECT object_id, 1 AS objects, count(*) AS fields, 0 AS critical_events, 0 AS informative_events, 0 AS created, 0 AS new_versions,
                  0 AS elements_added, 0 AS elements_updated, 0 AS elements_refused FROM {{fields_after}} GROUP BY object_id
           UNION ALL SELECT object_id, 0, 0, (change_type IN {_CRITICAL})::INT, (change_type NOT IN {_CRITICAL})::INT, 0, 0, 0, 0, 0 FROM events
           UNION ALL SELECT DISTINCT object_id, 0, 0, 0, 0, 1, 0, 0, 0, 0 FROM {{fields_after}}
                     WHERE object_id NOT IN (SELECT object_id FROM {{contract}})
           UNION ALL SELECT object_id, 0, 0, 0, 0, 0, 1, 0, 0, 0 FROM changed
           UNION ALL SELECT object_id, 0, 0, 0, 0, 0, 0, (action = 'added')::INT, (action = 'updated')::INT, (action = 'refused')::INT FROM merged)
    SELECT concat('run_', {_ASSET}) AS run_id, {_ASSET} AS asset_id, sum(objects)::BIGINT AS objects, sum(fields)::BIGINT AS fields,
           sum(critical_events)::BIGINT AS critical_events, sum(informative_events)::BIGINT AS informative_events,
           sum(critical_events)::BIGINT AS approvals, sum(created)::BIGINT AS created, sum(new_versions)::BIGINT AS new_versions,
           sum(elements_added)::BIGINT AS elements_added, sum(elements_updated)::BIGINT AS elements_updated,
           sum(elements_refused)::BIGINT AS elements_refused
    FROM per GROUP BY 1, 2""")
def _(t: Inputs) -> DataFrame:
    known = t.fields_before.withColumn("asset_id", _asset()).where(_asset().cast("int") % 5 != 0)
    return discover_runs(_captured(t.fields_after, "run_"), known, t.contract).totals


# Two runs of every asset: the later one found what changed since, the earlier one what had changed the other way.
_RUN_EVENTS = f"""
    SELECT concat('later_', {_ASSET}) AS run_id, {_ASSET} AS asset_id, object_id, field_name, change_type
    FROM ({_ALL}) WHERE change_type IN {_CRITICAL}
    UNION ALL
    SELECT concat('early_', {_ASSET}), {_ASSET}, object_id, field_name, change_type
    FROM ({_ALL.replace('fields_before', '@B').replace('fields_after', 'fields_before').replace('@B', 'fields_after')})
    WHERE change_type IN {_CRITICAL}"""
_STATE = f"""
    SELECT *, concat(run_id, '/', asset_id, '/', object_id, '/', coalesce(field_name, ''), '/', change_type) AS approval_id,
           CASE WHEN run_id LIKE 'early%' AND change_type = 'type_incompatible' THEN 'approved'
                WHEN run_id LIKE 'later%' AND change_type = 'nullable_to_required' THEN 'approved'
                WHEN field_name = 'f1' THEN 'rejected' ELSE 'pending' END AS decision
    FROM ({_RUN_EVENTS})"""


def _run_approvals(t: Inputs) -> DataFrame:
    """Approvals of both runs after the owners' decisions."""
    later = _captured(drift.diff(t.fields_before, t.fields_after, removed=True), "later_")
    early = _captured(drift.diff(t.fields_after, t.fields_before, removed=True), "early_")
    opened = approvals.open_approvals(later.unionByName(early))
    early_run, change = F.col("run_id").startswith("early"), F.col("change_type")
    decision = (F.when(early_run & (change == "type_incompatible"), "approved")
                .when(~early_run & (change == "nullable_to_required"), "approved")
                .when(F.col("field_name") == "f1", "rejected"))
    made = opened.select("approval_id", decision.alias("decision"), F.lit("owner").alias("decided_by"),
                         F.lit("2024-02-01").cast("date").alias("decided_at"), F.lit(None).cast("string").alias("notes"))
    return approvals.decide(opened, made.where("decision IS NOT NULL"))[0]


@query("approvals_by_run", f"""
    SELECT run_id, count(*) AS pending FROM ({_STATE}) WHERE decision = 'pending' GROUP BY run_id""")
def _(t: Inputs) -> DataFrame:
    return approvals.pending_approvals(_run_approvals(t), "run_id")


@query("approvals_of_one_run", f"""
    SELECT approval_id, asset_id, object_id, change_type, decision FROM ({_STATE}) WHERE run_id = 'early_7'""")
def _(t: Inputs) -> DataFrame:
    found = approvals.approvals_of_run(_run_approvals(t), "early_7")
    return found.select("approval_id", "asset_id", "object_id", "change_type", "decision")


@query("approvals_applied_elements", f"""
    WITH approved AS (SELECT DISTINCT run_id, object_id FROM ({_STATE}) WHERE decision = 'approved'),
         captured AS (
           SELECT *, concat('early_', {_ASSET}) AS run_id, 1 AS taken FROM {{fields_before}}
           UNION ALL SELECT *, concat('later_', {_ASSET}), 2 FROM {{fields_after}}),
         seen AS (SELECT c.*, rank() OVER (PARTITION BY c.object_id ORDER BY taken DESC) AS r
                  FROM captured c JOIN approved a ON a.run_id = c.run_id AND a.object_id = c.object_id),
         s AS (SELECT *, {_SNAPSHOT_TYPE} AS new_type FROM seen WHERE r = 1),
         j AS (SELECT coalesce(e.object_id, s.object_id) AS object_id, coalesce(e.name, s.name) AS name, e.source_type, e.destination_type,
                      e.required, e.nullable, s.new_type, s.nullable AS new_nullable,
                      CASE WHEN e.object_id IS NULL THEN 'added'
                           WHEN s.object_id IS NULL OR (e.destination_type = s.new_type AND e.nullable = s.nullable) THEN 'kept'
                           WHEN e.source_type = 'string' AND s.new_type IN ('integer', 'bigint', 'float', 'date', 'timestamp', 'boolean')
                           THEN 'refused' ELSE 'updated' END AS action
               FROM {{contract}} e FULL JOIN s ON e.object_id = s.object_id AND e.name = s.name)
    SELECT object_id, name, action, CASE WHEN action IN ('added', 'updated') THEN new_type ELSE destination_type END AS destination_type,
           CASE WHEN action IN ('added', 'updated') THEN new_nullable ELSE nullable END AS nullable FROM j""")
def _(t: Inputs) -> DataFrame:
    captured = _captured(t.fields_before, "early_").withColumn("taken", F.lit(1)).unionByName(
        _captured(t.fields_after, "later_").withColumn("taken", F.lit(2)))
    elements = approvals.apply_approved(t.contract, _run_approvals(t), captured, "taken")
    return elements.select("object_id", "name", "action", "destination_type", "nullable")
