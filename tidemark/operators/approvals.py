"""Discovery baselines and the approval of critical drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contract import apply_snapshot
from tidemark.operators.drift import CRITICAL


def baseline(runs: DataFrame) -> DataFrame:
    """Latest usable discovery run per asset. A mergeable aggregate, so a busy asset is no hot task."""
    usable = runs.where(F.col("status").isin("completed", "partial") & F.col("completed_at").isNotNull())
    others = [c for c in runs.columns if c != "asset_id"]
    latest = F.max_by(F.struct(*others), F.struct("completed_at", "run_id"))
    return usable.groupBy("asset_id").agg(latest.alias("r")).select("asset_id", "r.*")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` runs per asset; each task keeps only its own top ``n`` per asset before the shuffle."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def _part(name: str) -> Column:
    """A part of an id, with the separator escaped so that two ids never meet."""
    return F.replace(F.replace(F.col(name).cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


#: What an approval is bound to, where the events say it: the discovery run that found the event, and its asset.
BOUND = ("run_id", "asset_id")


def open_approvals(events: DataFrame) -> DataFrame:
    """One pending approval per critical event, named by what it is bound to, the object, the field and the change.

    The same change found by two runs is two approvals.
    """
    bound = [c for c in BOUND if c in events.columns]
    parts = [*[_part(c) for c in bound], _part("object_id"), F.coalesce(_part("field_name"), F.lit("")), F.col("change_type")]
    return events.where(F.col("change_type").isin(*CRITICAL)).select(
        F.concat_ws("/", *parts).alias("approval_id"), *bound,
        "object_id", "field_name", "change_type", F.col("description").alias("severity_description"),
        F.lit("pending").alias("decision"),
    )


def pending_approvals(approvals: DataFrame, by: str = "asset_id") -> DataFrame:
    """Pending approvals per asset, or per run."""
    return approvals.where("decision = 'pending'").groupBy(by).agg(F.count("*").alias("pending"))


def approvals_of_run(approvals: DataFrame, run_id: Column | str) -> DataFrame:
    """All approvals that a discovery run opened, whatever became of them."""
    return approvals.where(F.col("run_id") == run_id)


def decide(approvals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approvals after a set of decisions, and the decisions refused.

    Only a pending approval moves, by its earliest decision (decided_at, then decision); any further one,
    one on an approval already decided and one on an unknown approval are refused.
    """
    first = decisions.groupBy("approval_id").agg(
        F.min(F.struct("decided_at", "decision", "decided_by", "notes")).alias("_d"),
        F.count("*").alias("_times"),
    )
    moves = (F.col("decision") == "pending") & F.col("_d").isNotNull()
    others = [c for c in approvals.columns if c != "decision"]
    joined = approvals.join(first, "approval_id", "left")
    decided = joined.select(
        *others,
        F.when(moves, F.col("_d.decision")).otherwise(F.col("decision")).alias("decision"),
        F.when(moves, F.col("_d.decided_by")).alias("decided_by"),
        F.when(moves, F.col("_d.decided_at")).alias("decided_at"),
        F.when(moves, F.col("_d.notes")).alias("owner_notes"),
    )
    state = approvals.select("approval_id", F.col("decision").alias("_before"))
    refused = first.join(state, "approval_id", "left").select(
        "approval_id",
        F.when(F.col("_before") == "pending", F.col("_times") - 1).otherwise(F.col("_times")).alias("refused"),
        F.when(F.col("_before").isNull(), "not found").otherwise("already decided").alias("reason"),
    ).where("refused > 0")
    return decided, refused


def approved_snapshots(decided: DataFrame, snapshots: DataFrame, order: str | None = None) -> DataFrame:
    """Snapshot fields of the objects with an approved event; rejected ones apply nothing.

    Approvals that are bound to runs take the fields that their own run saw. Where several runs of an object were
    approved, that with the greatest ``order`` (a column of the snapshots, such as when the run ended) wins.
    """
    if "run_id" not in decided.columns:
        approved = decided.where("decision = 'approved'").select("object_id").distinct()
        return snapshots.join(approved, "object_id", "left_semi")
    approved = decided.where("decision = 'approved'").select("run_id", "object_id").distinct()
    seen = snapshots.join(approved, ["run_id", "object_id"], "left_semi")
    last = seen.groupBy("object_id").agg(F.max_by("run_id", F.struct(order or "run_id", "run_id")).alias("run_id"))
    return seen.join(last, ["run_id", "object_id"], "left_semi")


def apply_approved(elements: DataFrame, decided: DataFrame, snapshots: DataFrame, order: str | None = None) -> DataFrame:
    """Contract elements after the approved snapshots were merged into them, with the action taken for each.

    Objects without an approved event keep their elements; what is destructive is refused here as well.
    """
    chosen = approved_snapshots(decided, snapshots, order)
    touched = chosen.select("object_id").distinct()
    rest = elements.join(touched, "object_id", "left_anti").withColumn("action", F.lit("kept"))
    return apply_snapshot(elements.join(touched, "object_id", "left_semi"), chosen).unionByName(rest.select(*_ELEMENT, "action"))


_ELEMENT = ["object_id", "name", "source_type", "destination_type", "required", "nullable", "is_primary_key", "description"]
