"""Keeping destination contracts in step with discovered schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_contract_type

# Destinations a string source may not be turned into without confirmation.
REFUSED_FOR_STRING = ("integer", "bigint", "float", "date", "timestamp", "boolean")


def is_destructive(source: Column, destination: Column) -> Column:
    return F.coalesce((source == "string") & destination.isin(*REFUSED_FOR_STRING), F.lit(False))


def destructive_overrides(elements: DataFrame) -> DataFrame:
    """Elements whose destination type would lose values of their source type."""
    return elements.where(is_destructive(F.col("source_type"), F.col("destination_type")))


def objects_to_heal(snapshot: DataFrame, events: DataFrame, has_baseline: bool) -> DataFrame:
    """Object ids whose contract follows the snapshot: informative drift, or no baseline at all."""
    if not has_baseline:
        return snapshot.select("object_id").distinct()
    return events.where("severity = 'informative'").select("object_id").distinct()


def apply_snapshot(elements: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Merge discovered fields into contract elements, with the action taken for each.

    New fields are added without their key flag; changed type or nullability updates; nothing is ever
    dropped; a refused override leaves the element as it was and is reported as ``refused``.
    """
    found = snapshot.select(
        F.col("object_id"), F.col("name"), as_contract_type(F.col("normalized_type")).alias("_type"),
        F.col("nullable").alias("_nullable"), F.col("description").alias("_description"),
        F.lit(True).alias("_found"),
    )
    merged = elements.withColumn("_known", F.lit(True)).join(found, ["object_id", "name"], "full_outer")
    differs = (F.col("destination_type") != F.col("_type")) | (F.col("nullable") != F.col("_nullable"))
    action = (
        F.when(F.col("_known").isNull(), "added")
        .when(F.col("_found").isNull() | ~differs, "kept")
        .when(is_destructive(F.col("source_type"), F.col("_type")), "refused")
        .otherwise("updated")
    )
    follow = F.col("action").isin("added", "updated")
    return merged.withColumn("action", action).select(
        "object_id", "name",
        F.coalesce("source_type", "_type").alias("source_type"),
        F.when(follow, F.col("_type")).otherwise(F.col("destination_type")).alias("destination_type"),
        F.when(follow, ~F.col("_nullable")).otherwise(F.col("required")).alias("required"),
        F.when(follow, F.col("_nullable")).otherwise(F.col("nullable")).alias("nullable"),
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        F.coalesce("description", "_description", F.lit("")).alias("description"),
        "action",
    )
