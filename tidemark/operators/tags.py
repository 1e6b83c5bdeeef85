"""Sensitivity tags: suggestions from column names and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, tag, confidence), the first match wins, case ignored.
TAG_RULES = (
    ("cpf|cnpj", "RESTRICTED", "high"),
    ("password|senha", "RESTRICTED", "high"),
    ("email", "PII", "high"),
    ("phone|telefone|celular", "PII", "medium"),
    ("address|endereco|cep|zipcode", "PII", "medium"),
    ("name|nome", "PII", "low"),
)


def _first_match(name: Column, position: int) -> Column:
    chain = F.lit(None).cast("string")
    for rule in reversed(TAG_RULES):
        chain = F.when(name.rlike(f"(?i){rule[0]}"), rule[position]).otherwise(chain)
    return chain


def infer_policy_tags(fields: DataFrame, name: str = "name", confidence: str | None = None) -> DataFrame:
    """Suggested tags for the fields whose name matches a rule, optionally of one confidence only."""
    column = F.col(name)
    suggested = fields.withColumn("matched_pattern", _first_match(column, 0)).where("matched_pattern IS NOT NULL")
    tagged = (
        suggested.withColumn("suggested_tag", _first_match(column, 1))
        .withColumn("confidence", _first_match(column, 2))
        .withColumn(
            "auto_generated_description",
            F.concat(F.lit("Auto-suggested based on field name matching '"), "matched_pattern", F.lit("'")),
        )
    )
    return tagged if confidence is None else tagged.where(F.col("confidence") == confidence)


def effective_tags(assets: DataFrame, objects: DataFrame, elements: DataFrame) -> DataFrame:
    """Tag of every element: its own, else its object's, else its asset's, and where it came from.

    assets(asset_id, asset_tag), objects(object_id, asset_id, object_tag), elements(object_id, name, element_tag).
    """
    inherited = objects.join(assets, "asset_id", "left")
    return elements.join(inherited, "object_id", "left").select(
        "object_id", "name",
        F.coalesce("element_tag", "object_tag", "asset_tag").alias("effective_tag"),
        F.when(F.col("element_tag").isNotNull(), "element")
        .when(F.col("object_tag").isNotNull(), "object")
        .when(F.col("asset_tag").isNotNull(), "asset")
        .otherwise("none")
        .alias("inherited_from"),
    )
