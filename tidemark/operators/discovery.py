"""Discovery runs of many assets as one chain: provision, diff, severity, self-heal or approvals, versions, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.approvals import open_approvals
from tidemark.operators.contract import apply_snapshot
from tidemark.operators.drift import diff, with_severity
from tidemark.operators.versions import VERSIONED, snapshot_json
from tidemark.session import cut


@dataclass(frozen=True)
class Discovery:
    """What the runs found and did. All but the totals have a row per object, event, approval or element."""

    provisioned: DataFrame
    events: DataFrame
    approvals: DataFrame
    elements: DataFrame
    versions: DataFrame
    totals: DataFrame


def field_lists(fields: DataFrame) -> DataFrame:
    """(object_id, snapshot_json): an object's fields in their order, as long as its schema is wide."""
    listed = fields.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *VERSIONED))).alias("fields"))
    return listed.select("object_id", snapshot_json().alias("snapshot_json"))


def discover_runs(snapshots: DataFrame, baseline: DataFrame, elements: DataFrame, removed: bool = False) -> Discovery:
    """Process the snapshots of discovery runs, one run an asset, against what was known before.

    ``snapshots``: run_id, asset_id and the fields of every object found. ``baseline``: asset_id and the fields of the asset's
    latest usable run. ``elements``: contract elements of known objects. An object without elements is created. Informative
    drift, or an asset without any baseline, lets an object's elements follow its snapshot; critical drift opens approvals
    that are bound to the run. An object that is missing from its run's snapshots changes nothing; with ``removed`` it is
    reported as an event. A snapshot that differs from the baseline's is a new version.
    """
    fields = [c for c in snapshots.columns if c not in ("run_id", "asset_id")]
    owners = snapshots.groupBy("object_id").agg(F.max("run_id").alias("run_id"), F.max("asset_id").alias("asset_id"))
    # Only assets that have a run now are compared.
    runs = snapshots.groupBy("asset_id").agg(F.max("run_id").alias("run_id"))
    before = baseline.join(runs, "asset_id")
    gone = before.groupBy("object_id").agg(F.max("run_id").alias("run_id"), F.max("asset_id").alias("asset_id"))
    owners = owners.unionByName(gone).distinct()
    events = cut(with_severity(diff(before.select(*fields), snapshots.select(*fields), removed)).join(owners, "object_id"), "drift-events")
    approvals = open_approvals(events.join(snapshots.select("object_id").distinct(), "object_id", "left_semi"))

    known = elements.select("object_id").distinct()
    created = snapshots.select("run_id", "asset_id", "object_id").distinct().join(known, "object_id", "left_anti")
    assets_before = baseline.select("asset_id").distinct()
    first = snapshots.select("asset_id", "object_id").distinct().join(assets_before, "asset_id", "left_anti").select("object_id")
    healed = events.where("severity = 'informative'").select("object_id").unionByName(first).distinct()
    chosen = snapshots.join(healed, "object_id", "left_semi").select(*fields)
    found = chosen.select("object_id").distinct()
    merged = cut(apply_snapshot(elements.join(found, "object_id", "left_semi"), chosen), "healed")
    kept = elements.join(found, "object_id", "left_anti").withColumn("action", F.lit("kept")).select(*merged.columns)

    old = field_lists(before).withColumnRenamed("snapshot_json", "_before")
    now = field_lists(snapshots).join(old, "object_id", "left").where(~F.col("snapshot_json").eqNullSafe(F.col("_before")))
    versions = now.join(owners, "object_id").select("run_id", "asset_id", "object_id", "snapshot_json")
    totals = _totals(snapshots, events, approvals, created, versions, merged.join(owners, "object_id"))
    return Discovery(created, events, approvals, merged.unionByName(kept), versions, totals)


def _totals(snapshots: DataFrame, events: DataFrame, approvals: DataFrame, created: DataFrame, versions: DataFrame, healed: DataFrame) -> DataFrame:
    """One row per run: everything is counted by run before it meets."""
    def count(rows: DataFrame, **counts: Column) -> DataFrame:
        return rows.groupBy("run_id", "asset_id").agg(*[c.alias(name) for name, c in counts.items()])

    one = F.count(F.lit(1))
    parts = [
        count(snapshots.groupBy("run_id", "asset_id", "object_id").agg(one.alias("n")), objects=one, fields=F.sum("n")),
        count(events, critical_events=F.count_if(F.col("severity") == "critical"),
              informative_events=F.count_if(F.col("severity") == "informative")),
        count(approvals, approvals=one), count(created, created=one), count(versions, new_versions=one),
        count(healed, **{f"elements_{a}": F.count_if(F.col("action") == a) for a in ("added", "updated", "refused")}),
    ]
    names = [c for part in parts for c in part.columns[2:]]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy("run_id", "asset_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])
