"""Fields inferred from JSON documents and from declared document and API schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.globs import matches_any
from tidemark.functions.types import normalize_types
from tidemark.session import cut
from tidemark.sources.pages import envelope_items


def _value_type(value: Column) -> Column:
    """Name of a variant value's kind, in the words of the sampled-value type map."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "NoneType")
        .when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind == "STRING", "str")
        .when(kind == "BINARY", "bytes")
        # Whole numbers past BIGINT arrive as decimals of 19 digits and more.
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int")
        .otherwise("float")
    )


def _entries(docs: DataFrame, keep: list[str], body: str) -> DataFrame:
    """Key/value pairs of a variant object column, with their position."""
    exploded = docs.select(*keep, F.col(body).alias("_doc")).lateralJoin(
        docs.sparkSession.tvf.variant_explode(F.col("_doc").outer())
    )
    return exploded.select(*keep, F.col("pos").alias("position"), F.col("key").alias("name"),
                           F.col("value").alias("_value"))


def unreadable_documents(docs: DataFrame, body_col: str, object_col: str) -> DataFrame:
    """Documents per collection, and how many of them cannot be parsed."""
    broken = F.col(body_col).isNotNull() & F.try_parse_json(F.col(body_col)).isNull()
    return docs.groupBy(F.col(object_col).alias("object_id")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(broken).alias("unreadable"))


def infer_json_fields(
    docs: DataFrame, body_col: str, object_col: str
) -> DataFrame:
    """Fields of document collections: one observed type is the type, several make it a string.

    A null counts as a type of its own and alone becomes a string; ``_id`` is skipped; all fields are
    nullable. Every document is read; ``unreadable_documents`` counts those that are no JSON.
    """
    parsed = docs.select(F.col(object_col).alias("object_id"), F.try_parse_json(F.col(body_col)).alias("_body"))
    observed = _entries(parsed, ["object_id"], "_body").where("name IS NOT NULL AND name <> '_id'")
    typed = observed.select("object_id", "name", _value_type(F.col("_value")).alias("_type"))
    # min and max merge map-side: equal means one type, so no set of types is ever collected.
    fields = typed.groupBy("object_id", "name").agg(
        F.min("_type").alias("_low"), F.max("_type").alias("_high"), F.count("*").alias("documents")
    )
    settled = fields.select(
        "object_id", "name", F.lit("sample").alias("system"), F.lit("").alias("format"),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("str").alias("type"), "documents",
    )
    return normalize_types(settled).select(
        "object_id", "name", F.concat(F.lit("python:"), "type").alias("source_type"), "normalized_type",
        F.lit(True).alias("nullable"), F.lit(False).alias("is_primary_key"), "documents",
    )


def infer_nested_fields(docs: DataFrame, body_col: str, object_col: str) -> DataFrame:
    """Fields of document collections at every depth, each with the collection's unreadable documents.

    ``path`` joins the keys of objects by dots and names the elements of an array by ``[]``. The rules are those of
    ``infer_json_fields`` at every path: one observed kind is the type, several make it a string, a null is a kind of its
    own. ``observed`` counts values, so an array counts each element. A level is one pass over the nested values of the level
    above, written in between; keys with dots are quoted by backticks.
    """
    parsed = docs.select(F.col(object_col).alias("object_id"), F.lit("").alias("path"), F.lit("dict").alias("_type"),
                         F.try_parse_json(F.col(body_col)).alias("_value"))
    level, found, depth = parsed, None, 0
    while True:
        values = level.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_value").outer()))
        key = F.when(F.col("key").contains(".") | F.col("key").contains("`"),
                     F.concat(F.lit("`"), F.replace("key", F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(F.col("key"))
        inner = values.select(
            "object_id", F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", key).otherwise(
                F.concat("path", F.lit("."), key)).alias("path"),
            "key", "pos", F.col("value").alias("_value")).where("pos IS NOT NULL")
        if not depth:
            # Collections hold objects; what else a document may be has no fields.
            inner = inner.where("key IS NOT NULL AND key <> '_id'")
        typed = cut(inner.select("object_id", "path", _value_type(F.col("_value")).alias("_type"), "_value"), "nested")
        kinds = typed.groupBy("object_id", "path").agg(
            F.min("_type").alias("_low"), F.max("_type").alias("_high"), F.count(F.lit(1)).alias("observed"))
        found = kinds if found is None else found.unionByName(kinds)
        level, depth = typed.where("_type IN ('dict', 'list')"), depth + 1
        if level.isEmpty():
            break
    settled = found.select(
        "object_id", "path", F.lit("sample").alias("system"), F.lit("").alias("format"),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("str").alias("type"), "observed")
    broken = unreadable_documents(docs, body_col, object_col)
    return normalize_types(settled).join(broken, "object_id").select(
        "object_id", "path", F.concat(F.lit("python:"), "type").alias("source_type"), "normalized_type", "observed",
        "documents", "unreadable")


def infer_first_item(pages: DataFrame, body_col: str, object_col: str, order_col: str) -> DataFrame:
    """Fields of an API resource from the first item of its first page; ``id`` in any case is the key."""
    first = pages.groupBy(F.col(object_col).alias("object_id")).agg(F.min_by(body_col, order_col).alias("_body"))
    parsed = first.select("object_id", F.try_parse_json("_body").alias("_body"))
    whole = F.when(F.schema_of_variant("_body").startswith("OBJECT"), F.col("_body"))
    items = envelope_items(F.col("_body"))
    # An enveloped list gives its first item; an object without one is itself the sample.
    sample = F.when(items.isNotNull(), F.get(items, F.lit(0))).otherwise(whole)
    observed = _entries(parsed.select("object_id", sample.alias("_item")), ["object_id"], "_item")
    typed = observed.where("name IS NOT NULL").select(
        "object_id", "name", F.lit("sample").alias("system"), F.lit("").alias("format"),
        _value_type(F.col("_value")).alias("type"),
    )
    return normalize_types(typed).select(
        "object_id", "name", F.concat(F.lit("python:"), "type").alias("source_type"), "normalized_type",
        F.lit(True).alias("nullable"), (F.lower("name") == "id").alias("is_primary_key"),
    )


def _required(spec: Column) -> Column:
    return F.coalesce(F.try_variant_get(spec, "$.required", "array<string>"), F.array().cast("array<string>"))


def fields_from_json_schema(specs: DataFrame, spec_col: str, object_col: str) -> DataFrame:
    """Fields declared by document validators; a list of types gives its first non-null one."""
    parsed = specs.select(F.col(object_col).alias("object_id"), F.try_parse_json(F.col(spec_col)).alias("_spec"))
    shaped = parsed.select(
        "object_id", _required(F.col("_spec")).alias("_required"),
        F.try_variant_get("_spec", "$.properties", "variant").alias("_props"),
    )
    fields = _entries(shaped, ["object_id", "_required"], "_props").where("name IS NOT NULL")
    several = F.try_variant_get("_value", "$.bsonType", "array<string>")
    declared = F.when(
        several.isNotNull(), F.get(F.filter(several, lambda t: t != "null"), F.lit(0))
    ).otherwise(F.try_variant_get("_value", "$.bsonType", "string"))
    typed = fields.select(
        "object_id", "name", F.lit("bson").alias("system"), F.lit("").alias("format"),
        F.coalesce(declared, F.lit("string")).alias("type"),
        (~F.array_contains("_required", F.col("name"))).alias("nullable"),
    )
    return normalize_types(typed).select(
        "object_id", "name", F.concat(F.lit("bson:"), "type").alias("source_type"), "normalized_type", "nullable",
        F.lit(False).alias("is_primary_key"),
    )


def fields_from_openapi(
    specs: DataFrame, spec_col: str, object_col: str, include: list[str] | None = None
) -> DataFrame:
    """Fields of the component schemas of API specs whose names match an include glob."""
    parsed = specs.select(
        F.col(object_col).alias("object_id"),
        F.try_variant_get(F.try_parse_json(F.col(spec_col)), "$.components.schemas", "variant").alias("_schemas"),
    )
    schemas = _entries(parsed, ["object_id"], "_schemas").where("name IS NOT NULL")
    chosen = schemas.where(matches_any(F.col("name"), include or ["*"])).select(
        "object_id", F.col("name").alias("schema_name"), _required(F.col("_value")).alias("_required"),
        F.try_variant_get("_value", "$.properties", "variant").alias("_props"),
    )
    fields = _entries(chosen, ["object_id", "schema_name", "_required"], "_props").where("name IS NOT NULL")

    def prop(key: str, kind: str = "string") -> Column:
        return F.try_variant_get("_value", f"$['{key}']", kind)

    typed = fields.select(
        "object_id", "schema_name", "name", F.lit("openapi").alias("system"),
        F.coalesce(prop("type"), F.lit("string")).alias("type"),
        F.coalesce(prop("format"), F.lit("")).alias("format"),
        (~F.array_contains("_required", F.col("name"))).alias("nullable"),
        ((F.lower("name") == "id") | F.coalesce(prop("x-primary-key", "boolean"), F.lit(False))).alias(
            "is_primary_key"
        ),
        prop("description").alias("description"),
    )
    raw = F.when(F.col("format") != "", F.concat("type", F.lit("("), "format", F.lit(")"))).otherwise(F.col("type"))
    return normalize_types(typed).select(
        "object_id", "schema_name", "name", F.concat(F.lit("openapi:"), raw).alias("source_type"),
        "normalized_type", "nullable", "is_primary_key", "description",
    )


def discover(declared: DataFrame, sampled: DataFrame) -> DataFrame:
    """Declared fields where an object has a spec, sampled ones elsewhere, with the method used."""
    columns = ["object_id", "name", "source_type", "normalized_type", "nullable", "is_primary_key"]
    specified = declared.select("object_id").distinct()
    rest = sampled.join(specified, "object_id", "left_anti")
    return declared.select(*columns, F.lit("declared").alias("discovery_method")).unionByName(
        rest.select(*columns, F.lit("payload_sampling").alias("discovery_method"))
    )
