"""Registered queries: drift, approvals, schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import approvals, drift, versions
from tidemark.plans.registry import Inputs, query

# Oracle text of all events from fields_before to fields_after.
_PAIRS = """
    SELECT coalesce(b.object_id, a.object_id) AS object_id, coalesce(b.name, a.name) AS name,
           b.name IS NOT NULL AS had, a.name IS NOT NULL AS has, b.normalized_type AS old, a.normalized_type AS new,
           b.nullable AS was, a.nullable AS now, b.ordinal AS p_ord, a.ordinal AS c_ord
    FROM {fields_before} b FULL JOIN {fields_after} a ON b.object_id = a.object_id AND b.name = a.name
    WHERE coalesce(b.object_id, a.object_id) IN (SELECT object_id FROM {fields_before})
      AND coalesce(b.object_id, a.object_id) IN (SELECT object_id FROM {fields_after})"""

_TYPE_EVENTS = f"""
    SELECT object_id, name AS field_name,
           CASE WHEN lower(old) = lower(new) OR (lower(old), lower(new)) IN (('integer', 'bigint'), ('integer', 'float'),
                     ('integer', 'decimal'), ('bigint', 'float'), ('bigint', 'decimal'), ('float', 'decimal'))
                THEN 'type_widened' ELSE 'type_incompatible' END AS change_type,
           old, new, c_ord, p_ord
    FROM ({_PAIRS}) WHERE had AND has AND old <> new"""

_EVENTS = f"""
    SELECT object_id, name AS field_name, 'field_added' AS change_type, concat('Field ', name, ' added.') AS description,
           CAST(NULL AS VARCHAR) AS previous_value, new AS current_value, 0 AS phase, c_ord AS ord, 0 AS kind
    FROM ({_PAIRS}) WHERE NOT had
    UNION ALL
    SELECT object_id, field_name, change_type,
           concat(CASE WHEN change_type = 'type_widened' THEN 'Type widened from ' ELSE 'Incompatible type change from ' END,
                  old, ' to ', new, '.'), old, new, 0, c_ord, 0
    FROM ({_TYPE_EVENTS})
    UNION ALL
    SELECT object_id, name, CASE WHEN was THEN 'nullable_to_required' ELSE 'required_to_nullable' END,
           concat('Field ', name, CASE WHEN was THEN ' changed from nullable to required.'
                                       ELSE ' changed from required to nullable.' END), NULL, NULL, 0, c_ord, 1
    FROM ({_PAIRS}) WHERE had AND has AND was <> now
    UNION ALL
    SELECT object_id, name, 'field_removed', concat('Field ', name, ' removed.'), old, NULL, 1, p_ord, 0
    FROM ({_PAIRS}) WHERE NOT has"""

_CRITICAL = "('field_removed', 'type_incompatible', 'nullable_to_required', 'object_removed')"
_SHOWN = ["object_id", "field_name", "change_type", "description", "previous_value", "current_value"]
_SHOWN_SQL = ", ".join(_SHOWN)

_ADDED = """
    SELECT DISTINCT object_id, CAST(NULL AS VARCHAR) AS field_name, 'object_added' AS change_type,
           concat('Object ', object_id, ' added to source.') AS description, CAST(NULL AS VARCHAR) AS previous_value,
           CAST(NULL AS VARCHAR) AS current_value
    FROM {fields_after} WHERE object_id NOT IN (SELECT object_id FROM {fields_before})"""
_REMOVED = """
    SELECT DISTINCT object_id, CAST(NULL AS VARCHAR) AS field_name, 'object_removed' AS change_type,
           concat('Object ', object_id, ' removed from source.') AS description, CAST(NULL AS VARCHAR) AS previous_value,
           CAST(NULL AS VARCHAR) AS current_value
    FROM {fields_before} WHERE object_id NOT IN (SELECT object_id FROM {fields_after})"""
_ALL = f"SELECT {_SHOWN_SQL} FROM ({_EVENTS}) UNION ALL {_ADDED} UNION ALL {_REMOVED}"


def _events(t: Inputs) -> DataFrame:
    return drift.diff(t.fields_before, t.fields_after, removed=True)


@query("drift_object_added", _ADDED)
def _(t: Inputs) -> DataFrame:
    return drift.object_events(t.fields_before, t.fields_after).select(*_SHOWN)


@query("drift_object_removed", _REMOVED)
def _(t: Inputs) -> DataFrame:
    events = drift.object_events(t.fields_before, t.fields_after, removed=True)
    return events.where("change_type = 'object_removed'").select(*_SHOWN)


@query("drift_fields", f"SELECT {_SHOWN_SQL} FROM ({_EVENTS}) WHERE change_type IN ('field_added', 'field_removed')")
def _(t: Inputs) -> DataFrame:
    events = drift.field_events(t.fields_before, t.fields_after)
    return events.where("change_type IN ('field_added', 'field_removed')").select(*_SHOWN)


@query("drift_types", f"SELECT {_SHOWN_SQL} FROM ({_EVENTS}) WHERE change_type LIKE 'type_%'")
def _(t: Inputs) -> DataFrame:
    return drift.field_events(t.fields_before, t.fields_after).where("change_type LIKE 'type_%'").select(*_SHOWN)


@query("drift_nullability", f"SELECT {_SHOWN_SQL} FROM ({_EVENTS}) WHERE change_type LIKE '%_to_%'")
def _(t: Inputs) -> DataFrame:
    return drift.field_events(t.fields_before, t.fields_after).where("change_type LIKE '%_to_%'").select(*_SHOWN)


@query("drift_severity", f"""
    SELECT {_SHOWN_SQL}, CASE WHEN change_type IN {_CRITICAL} THEN 'critical' ELSE 'informative' END AS severity,
           change_type IN {_CRITICAL} AS requires_approval
    FROM ({_ALL})""")
def _(t: Inputs) -> DataFrame:
    return drift.with_severity(_events(t)).drop("event_order")


@query("drift_summary", f"""
    SELECT object_id, count(*) FILTER (WHERE change_type IN {_CRITICAL}) AS critical_events,
           count(*) FILTER (WHERE change_type NOT IN {_CRITICAL}) AS informative_events,
           count(*) FILTER (WHERE change_type IN {_CRITICAL}) > 0 AS has_critical
    FROM ({_ALL}) GROUP BY object_id""")
def _(t: Inputs) -> DataFrame:
    return drift.drift_summary(_events(t))


def _gate_sql(blocking: str) -> str:
    return f"""
    WITH objects AS (SELECT object_id FROM {{fields_before}} UNION SELECT object_id FROM {{fields_after}}),
         why AS (SELECT object_id, string_agg(concat(field_name, ': ', change_type), '; ' ORDER BY phase, ord, kind) AS reason
                 FROM ({_EVENTS}) WHERE change_type IN ({blocking}) GROUP BY object_id)
    SELECT o.object_id, reason IS NULL AS can_proceed,
           CASE WHEN reason IS NULL THEN '' ELSE concat('Incompatible drift detected: ', reason) END AS blocked_reason
    FROM objects o LEFT JOIN why ON why.object_id = o.object_id"""


@query("drift_gate", _gate_sql("'field_removed', 'type_incompatible'"))
def _(t: Inputs) -> DataFrame:
    before, after = t.fields_before, t.fields_after
    return drift.drift_gate(before, after, drift.field_events(before, after))


@query("drift_gate_strict", _gate_sql("'field_removed', 'type_incompatible', 'nullable_to_required'"))
def _(t: Inputs) -> DataFrame:
    before, after = t.fields_before, t.fields_after
    events = drift.field_events(before, after)
    return drift.drift_gate(before, after, events, (*drift.BLOCKING, "nullable_to_required"))


@query("drift_actions", f"""
    SELECT object_id, policy, has_critical, CASE WHEN has_critical OR policy = 'block' THEN 'block'
           WHEN policy = 'self_heal' THEN 'self_heal' ELSE 'alert' END AS action
    FROM (SELECT object_id, CASE length(object_id) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'self_heal' ELSE 'alert_only' END
                 AS policy, bool_or(change_type IN {_CRITICAL}) AS has_critical
          FROM ({_ALL}) GROUP BY object_id)""")
def _(t: Inputs) -> DataFrame:
    kind = F.length("object_id") % 3
    policy = F.when(kind == 0, "block").when(kind == 1, "self_heal").otherwise("alert_only")
    return drift.plan_actions(_events(t), policy)


@query("discovery_baseline", """
    SELECT asset_id, run_id, status, completed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY completed_at DESC, run_id DESC) AS rn
      FROM {discovery_runs} WHERE status IN ('completed', 'partial') AND completed_at IS NOT NULL) WHERE rn = 1""")
def _(t: Inputs) -> DataFrame:
    return approvals.baseline(t.discovery_runs).select("asset_id", "run_id", "status", "completed_at")


@query("recent_discovery_runs", """
    SELECT asset_id, run_id, status, recency FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, run_id DESC) AS INTEGER) AS recency
      FROM {discovery_runs}) WHERE recency <= 20""")
def _(t: Inputs) -> DataFrame:
    return approvals.recent_runs(t.discovery_runs).select("asset_id", "run_id", "status", "recency")


_OPENED = f"""
    SELECT concat(object_id, '/', coalesce(field_name, ''), '/', change_type) AS approval_id, object_id, field_name,
           change_type, description AS severity_description, 'pending' AS decision
    FROM ({_ALL}) WHERE change_type IN {_CRITICAL}"""


@query("approvals_opened", _OPENED)
def _(t: Inputs) -> DataFrame:
    return approvals.open_approvals(_events(t))


# Approvals on record: those of removed fields were rejected long ago. Then come decisions, some twice.
_RECORDED = f"""
    SELECT approval_id, object_id, field_name, change_type, split_part(object_id, '_', 3) AS asset_id,
           CASE WHEN change_type = 'field_removed' AND field_name = 'f0' THEN 'rejected' ELSE decision END AS decision
    FROM ({_OPENED})"""
_DECISIONS = f"""
    SELECT approval_id, 'approved' AS decision, 'owner' AS decided_by, DATE '2024-02-01' AS decided_at
    FROM ({_OPENED}) WHERE change_type = 'type_incompatible' OR field_name = 'f0'
    UNION ALL
    SELECT approval_id, 'rejected', 'auditor', DATE '2024-02-02'
    FROM ({_OPENED}) WHERE change_type = 'nullable_to_required' OR field_name = 'f1'"""


def _recorded(t: Inputs) -> DataFrame:
    opened = approvals.open_approvals(_events(t)).drop("severity_description")
    old = (F.col("change_type") == "field_removed") & (F.col("field_name") == "f0")
    return opened.withColumn("asset_id", F.split_part("object_id", F.lit("_"), F.lit(3))).withColumn(
        "decision", F.when(old, "rejected").otherwise(F.col("decision")))


def _decisions(recorded: DataFrame) -> DataFrame:
    def made(condition: str, decision: str, by: str, at: str) -> DataFrame:
        return recorded.where(condition).select(
            "approval_id", F.lit(decision).alias("decision"), F.lit(by).alias("decided_by"),
            F.lit(at).cast("date").alias("decided_at"), F.lit(None).cast("string").alias("notes"))

    return made("change_type = 'type_incompatible' OR field_name = 'f0'", "approved", "owner", "2024-02-01").unionByName(
        made("change_type = 'nullable_to_required' OR field_name = 'f1'", "rejected", "auditor", "2024-02-02"))


@query("approvals_pending", f"""
    SELECT asset_id, count(*) AS pending FROM ({_RECORDED}) WHERE decision = 'pending' GROUP BY asset_id""")
def _(t: Inputs) -> DataFrame:
    return approvals.pending_approvals(_recorded(t))


_DECIDED = f"""
    SELECT r.approval_id, r.object_id, r.change_type,
           CASE WHEN r.decision = 'pending' AND d.rn = 1 THEN d.decision ELSE r.decision END AS decision,
           CASE WHEN r.decision = 'pending' THEN d.decided_by END AS decided_by,
           CASE WHEN r.decision = 'pending' THEN CAST(d.decided_at AS VARCHAR) END AS decided_at
    FROM ({_RECORDED}) r
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY decided_at) AS rn FROM ({_DECISIONS})) d
    ON d.approval_id = r.approval_id AND d.rn = 1"""


@query("approvals_decided", _DECIDED)
def _(t: Inputs) -> DataFrame:
    recorded = _recorded(t)
    decided, _ = approvals.decide(recorded, _decisions(recorded))
    return decided.select("approval_id", "object_id", "change_type", "decision", "decided_by",
                          F.col("decided_at").cast("string").alias("decided_at"))


@query("approvals_refused", f"""
    SELECT d.approval_id, CASE WHEN any_value(r.decision) = 'pending' THEN count(*) - 1 ELSE count(*) END AS refused,
           'already decided' AS reason
    FROM ({_DECISIONS}) d JOIN ({_RECORDED}) r ON r.approval_id = d.approval_id GROUP BY d.approval_id
    HAVING count(*) > 1 OR any_value(r.decision) <> 'pending'""")
def _(t: Inputs) -> DataFrame:
    recorded = _recorded(t)
    return approvals.decide(recorded, _decisions(recorded))[1]


@query("approvals_applied", f"""
    SELECT object_id, name, normalized_type FROM {{fields_after}}
    WHERE object_id IN (SELECT object_id FROM ({_DECIDED}) WHERE decision = 'approved')""")
def _(t: Inputs) -> DataFrame:
    recorded = _recorded(t)
    decided, _ = approvals.decide(recorded, _decisions(recorded))
    return approvals.approved_snapshots(decided, t.fields_after).select("object_id", "name", "normalized_type")


def _snapshots(t: Inputs) -> DataFrame:
    """Schema captures with their ordered field list."""
    def field(name, kind, nullable, key, text):
        return F.struct(
            F.lit(name).alias("name"), kind.alias("source_type"), kind.alias("normalized_type"),
            nullable.alias("nullable"), F.lit(key).alias("is_primary_key"), F.lit(text).cast("string").alias("description"))

    key = field("id", F.lit("bigint"), F.lit(False), True, None)
    amount = field("amount", F.when(F.col("wide"), "bigint").otherwise("integer"), F.col("loose"), False, "sum of lines")
    note = field("note", F.lit("string"), F.lit(True), False, "free text")
    fields = F.when(F.col("swapped"), F.array(key, note, amount)).otherwise(F.array(key, amount, note))
    return t.schema_captures.select("object_id", "captured_at", "snapshot_id", fields.alias("fields"))


_ID_JSON = ('{"name":"id","source_type":"bigint","normalized_type":"bigint","nullable":false,"is_primary_key":true,'
            '"description":""}')
_NOTE_JSON = ('{"name":"note","source_type":"string","normalized_type":"string","nullable":true,"is_primary_key":false,'
              '"description":"free text"}')
_AMOUNT_SQL = """concat('{"name":"amount","source_type":"', kind, '","normalized_type":"', kind, '","nullable":',
                        CASE WHEN loose THEN 'true' ELSE 'false' END,
                        ',"is_primary_key":false,"description":"sum of lines"}')"""
_VERSIONS = f"""
    SELECT object_id, captured_at, snapshot_id, snapshot_json, wide, loose, swapped,
           row_number() OVER (PARTITION BY object_id ORDER BY captured_at, snapshot_id) AS version
    FROM (SELECT *, lag(snapshot_json) OVER (PARTITION BY object_id ORDER BY captured_at, snapshot_id) AS before
          FROM (SELECT *, concat('[{_ID_JSON},',
                                 CASE WHEN swapped THEN concat('{_NOTE_JSON},', {_AMOUNT_SQL})
                                      ELSE concat({_AMOUNT_SQL}, ',{_NOTE_JSON}') END, ']') AS snapshot_json
                FROM (SELECT *, CASE WHEN wide THEN 'bigint' ELSE 'integer' END AS kind FROM {{schema_captures}})))
    WHERE before IS NULL OR before <> snapshot_json"""


@query("schema_versions", f"SELECT object_id, captured_at, snapshot_id, snapshot_json, version FROM ({_VERSIONS})")
def _(t: Inputs) -> DataFrame:
    return versions.version_history(_snapshots(t))


_LATEST = f"SELECT object_id, max(version) AS version, arg_max(snapshot_json, version) AS snapshot_json FROM ({_VERSIONS}) GROUP BY object_id"


@query("schema_latest", _LATEST)
def _(t: Inputs) -> DataFrame:
    history = versions.version_history(_snapshots(t))
    return versions.latest_version(history).select("object_id", "version", "snapshot_json")


@query("schema_tag_version", f"""
    SELECT object_id, version + 1 AS version,
           replace(snapshot_json, '"description":"free text"}}',
                   CASE WHEN length(object_id) % 2 = 0 THEN '"description":"free text","policy_tag":"PII"}}'
                        ELSE '"description":"free text"}}' END) AS snapshot_json
    FROM ({_LATEST})""".replace("{\"", "{\""))
def _(t: Inputs) -> DataFrame:
    history = versions.version_history(_snapshots(t))
    tag = F.when(F.length("object_id") % 2 == 0, F.create_map(F.lit("note"), F.lit("PII"))).otherwise(
        F.create_map(F.lit("absent"), F.lit("PII")))
    tagged = t.schema_captures.select("object_id").distinct().withColumn("tags", tag)
    return versions.tag_version(history, tagged)


@query("schema_version_drift", f"""
    WITH v AS ({_VERSIONS}),
         p AS (SELECT object_id, version + 1 AS version, wide AS p_wide, loose AS p_loose FROM v),
         j AS (SELECT v.object_id, v.version, wide, loose, p_wide, p_loose
               FROM v JOIN p ON p.object_id = v.object_id AND p.version = v.version)
    SELECT object_id, version, 'amount' AS field_name,
           CASE WHEN wide THEN 'type_widened' ELSE 'type_incompatible' END AS change_type FROM j WHERE wide <> p_wide
    UNION ALL
    SELECT object_id, version, 'amount', CASE WHEN loose THEN 'required_to_nullable' ELSE 'nullable_to_required' END
    FROM j WHERE loose <> p_loose""")
def _(t: Inputs) -> DataFrame:
    history = versions.version_history(_snapshots(t))
    return versions.version_drift(history).select("object_id", "version", "field_name", "change_type")
