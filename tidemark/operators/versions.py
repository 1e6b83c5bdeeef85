"""Schema version history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Ordered
from tidemark.operators.drift import pair_events

VERSIONED = ["name", "source_type", "normalized_type", "nullable", "is_primary_key", "description"]


def snapshot_json(fields: str = "fields"):
    """Comparable text of an ordered field list: the order and the descriptions count."""
    return F.to_json(
        F.transform(
            F.col(fields),
            lambda f: F.struct(
                *[f[c].alias(c) for c in VERSIONED[:-1]],
                F.coalesce(f["description"], F.lit("")).alias("description"),
            ),
        )
    )


def version_history(snapshots: DataFrame) -> DataFrame:
    """A version for each snapshot that differs from the one before it; numbers start at 1 per object.

    ``snapshots``: object_id, captured_at, snapshot_id (breaks ties), fields array<struct>. An object
    snapshotted far more often than others does not end up in one task.
    """
    order = ["captured_at", "snapshot_id"]
    slim = snapshots.select("object_id", *order, snapshot_json().alias("snapshot_json"))
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("snapshot_json"))
    ordered = Ordered(slim, order, ["object_id"]).previous({"_before": "snapshot_json"})
    numbered = ordered.running_sum({"version": changed.cast("int")}).done()
    return numbered.where(changed).drop("_before")


def latest_version(versions: DataFrame) -> DataFrame:
    others = [c for c in versions.columns if c not in ("object_id", "version")]
    newest = F.max_by(F.struct(*others), "version")
    return versions.groupBy("object_id").agg(F.max("version").alias("version"), newest.alias("v")).select(
        "object_id", "version", "v.*"
    )


def tag_version(versions: DataFrame, tags: DataFrame) -> DataFrame:
    """The next version of each tagged object: its latest field list with the tags written in.

    ``tags``: object_id, tags map<string,string>. Objects without any version are skipped; the old
    versions stay as they are and the new rows are appended to them.
    """
    field = "struct<" + ",".join(
        f"{c}:{'boolean' if c in ('nullable', 'is_primary_key') else 'string'}" for c in (*VERSIONED, "policy_tag")
    ) + ">"
    stored = F.from_json("snapshot_json", f"array<{field}>")
    tagged = F.transform(
        stored,
        lambda f: f.withField("policy_tag", F.coalesce(F.col("tags")[f["name"]], f["policy_tag"])),
    )
    return (
        latest_version(versions)
        .join(tags, "object_id")
        .select("object_id", (F.col("version") + 1).alias("version"), F.to_json(tagged).alias("snapshot_json"))
    )


def version_drift(versions: DataFrame) -> DataFrame:
    """Drift events from each version to the next, labelled with the later version.

    Both field lists meet on one row, so fields are paired by name inside the row and nothing is joined.
    """
    kind = "array<struct<name:string,normalized_type:string,nullable:boolean>>"
    slim = versions.select("object_id", "version", "snapshot_json")
    steps = Ordered(slim, ["version"], ["object_id"]).previous({"_before": "snapshot_json"}).done()
    both = steps.where("_before IS NOT NULL").select(
        "object_id", "version", F.from_json("_before", kind).alias("p"), F.from_json("snapshot_json", kind).alias("c")
    )
    named = both.select(
        "object_id", "version", "p", "c",
        F.explode(F.array_union("c.name", "p.name")).alias("name"),
    )

    def side(mark: str) -> list:
        place = F.array_position(F.col(mark)["name"], F.col("name"))
        found = F.get(F.col(mark), (place - 1).cast("int"))
        return [
            found["normalized_type"].alias(f"{mark}_type"), found["nullable"].alias(f"{mark}_nullable"),
            F.when(place > 0, place).alias(f"{mark}_ordinal"),
        ]

    pairs = named.select("object_id", "version", "name", *side("p"), *side("c"))
    return pair_events(pairs, ["object_id", "version"])
