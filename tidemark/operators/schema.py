"""Schema snapshots of many tables, scope filters, structural metadata and provisioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.globs import matches_any
from tidemark.functions.types import CATALOG_TYPES, canonical_of, normalize_types

FIELD_COLUMNS = [
    "object_id", "ordinal", "name", "source_type", "normalized_type", "nullable", "is_primary_key", "description",
]


def snapshot(tables: dict[str, DataFrame], primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Schema fields of many tables, one row per column, from their schemas alone."""
    keys = primary_keys or {}
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (
            name, i, f.name, f.dataType.simpleString(), canonical_of(f.dataType), f.nullable,
            f.name in keys.get(name, []), f.metadata.get("comment", ""),
        )
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "object_id string, ordinal int, name string, source_type string, normalized_type string, "
        "nullable boolean, is_primary_key boolean, description string",
    )


def snapshot_from_catalog(columns: DataFrame, keys: DataFrame, indexes: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields and structures of a relational source from the rows of its catalogue.

    columns(table_schema, table_name, ordinal_position, column_name, data_type, is_nullable, column_comment),
    keys(table_schema, table_name, constraint_name, constraint_type PRIMARY KEY or FOREIGN KEY, ordinal_position, column_name,
    referred_table, referred_column), indexes(table_schema, table_name, index_name, is_unique, ordinal_position, column_name),
    tables(table_schema, table_name, table_comment, row_estimate). Composite keys and indexes are put together again in the
    order of their columns; indexes without a name are left out. A column in several foreign keys names the table of the
    last by constraint name. A table without columns has a structure and no fields; a null schema leaves the bare name.
    """
    def owned(df: DataFrame) -> DataFrame:
        return df.withColumn("object_id", F.concat_ws(".", "table_schema", "table_name"))

    def in_order(*names: str) -> Column:
        """Columns of one constraint by position: as many as the constraint has."""
        listed = F.sort_array(F.collect_list(F.struct("ordinal_position", *names)))
        return F.struct(*[listed[name].alias(name) for name in names])

    keys, indexes = owned(keys), owned(indexes).where("index_name IS NOT NULL")
    primary = keys.where("constraint_type = 'PRIMARY KEY'")
    foreign = keys.where("constraint_type = 'FOREIGN KEY'")
    pk = primary.groupBy("object_id").agg(in_order("column_name").alias("c")).select("object_id", F.col("c.column_name").alias("primary_key"))
    fk = foreign.groupBy("object_id", "constraint_name").agg(
        in_order("column_name", "referred_column").alias("c"), F.max("referred_table").alias("referred_table"))
    fk = fk.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("constraint_name").alias("name"), F.col("c.column_name").alias("constrained_columns"), "referred_table",
        F.col("c.referred_column").alias("referred_columns")))).alias("foreign_keys"))
    ix = indexes.groupBy("object_id", "index_name").agg(in_order("column_name").alias("c"), F.bool_or("is_unique").alias("unique"))
    ix = ix.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("index_name").alias("name"), F.col("c.column_name").alias("columns"), "unique"))).alias("indexes"))
    objects = owned(tables).select("object_id", "table_comment", "row_estimate").join(pk, "object_id", "left").join(
        fk, "object_id", "left").join(ix, "object_id", "left")
    none = {name: F.array().cast(objects.schema[name].dataType) for name in ("primary_key", "foreign_keys", "indexes")}
    structures = objects.withColumns({name: F.coalesce(name, empty) for name, empty in none.items()})

    column = ["object_id", "column_name"]
    known = primary.select(*column).distinct().withColumn("is_primary_key", F.lit(True))
    refers = foreign.groupBy(*column).agg(F.max_by("referred_table", "constraint_name").alias("fk_to"))
    members = indexes.groupBy(*column).agg(F.array_sort(F.collect_set("index_name")).alias("indexes"))
    kind = F.lower("data_type")
    class_of = F.create_map(*[F.lit(x) for pair in CATALOG_TYPES.items() for x in pair])
    named = owned(columns).withColumns({"system": F.lit("relational"), "format": F.lit(""), "type": class_of[kind]})
    fields = normalize_types(named).join(known, column, "left").join(refers, column, "left").join(members, column, "left")
    return fields.select(
        "object_id", F.col("ordinal_position").cast("int").alias("ordinal"), F.col("column_name").alias("name"),
        F.col("data_type").alias("source_type"), "normalized_type", F.coalesce(F.upper("is_nullable") != "NO", F.lit(True)).alias("nullable"),
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"), F.coalesce("column_comment", F.lit("")).alias("description"),
        "fk_to", F.coalesce("indexes", F.array().cast("array<string>")).alias("indexes"),
    ), structures


def scope_filter(
    objects: DataFrame, include: list[str], exclude: list[str] | None = None, mode: str = "document",
    namespace: str = "namespace", name: str = "name", honour_exclude: bool = False,
) -> DataFrame:
    """Objects inside a discovery scope.

    ``document``: globs on the full (``namespace.name``) or short name; exclude wins; no include means all.
    ``relational``: ``schema.table`` or a bare table, ``*`` only as a whole table name, schema equal;
    a bare pattern addresses the default schema (null). Excludes only count with ``honour_exclude``.
    """
    exclude = exclude or []
    short = F.col(name)
    full = F.concat_ws(".", F.col(namespace), short)
    dropped = matches_any(full, exclude) | matches_any(short, exclude)
    if mode == "document":
        patterns = include or ["*"]
        return objects.where((matches_any(full, patterns) | matches_any(short, patterns)) & ~dropped)
    kept = F.lit(False)
    for pattern in include or ["*"]:
        schema, table = pattern.split(".", 1) if "." in pattern else (None, pattern)
        in_schema = F.col(namespace).eqNullSafe(F.lit(schema))
        kept = kept | (in_schema if table == "*" else in_schema & (short == table))
    return objects.where(kept & ~dropped if honour_exclude else kept)


def flatten_constraints(objects: DataFrame) -> DataFrame:
    """Primary key, index and foreign key membership, one row per column of each constraint.

    ``objects``: object_id, primary_key array<string>, indexes array<struct<name,columns,unique>>,
    foreign_keys array<struct<name,constrained_columns,referred_table,referred_columns>>.
    """
    none = F.lit(None).cast("string")
    pk = objects.select("object_id", F.posexplode("primary_key").alias("position", "column")).select(
        "object_id", F.lit("primary_key").alias("kind"), F.lit("primary_key").alias("constraint_name"), "position",
        "column", F.lit(True).alias("is_unique"), none.alias("referred_table"), none.alias("referred_column"),
    )
    index = (
        objects.select("object_id", F.explode("indexes").alias("ix"))
        .where("ix.name IS NOT NULL")
        .select("object_id", F.col("ix.name").alias("constraint_name"), F.col("ix.unique").alias("is_unique"),
                F.posexplode("ix.columns").alias("position", "column"))
        .select("object_id", F.lit("index").alias("kind"), "constraint_name", "position", "column",
                F.coalesce("is_unique", F.lit(False)).alias("is_unique"), none.alias("referred_table"),
                none.alias("referred_column"))
    )
    fk = (
        objects.select("object_id", F.explode("foreign_keys").alias("fk"))
        .select(
            "object_id", F.coalesce("fk.name", F.lit("unnamed_fk")).alias("constraint_name"),
            F.col("fk.referred_table").alias("referred_table"),
            F.posexplode(F.arrays_zip(F.col("fk.constrained_columns").alias("c"),
                                      F.col("fk.referred_columns").alias("r"))).alias("position", "pair"),
        )
        .select("object_id", F.lit("foreign_key").alias("kind"), "constraint_name", "position",
                F.col("pair.c").alias("column"), F.lit(False).alias("is_unique"), "referred_table",
                F.col("pair.r").alias("referred_column"))
    )
    return pk.unionByName(index).unionByName(fk)


def discovery_summary(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Totals per discovery run.

    ``runs``: run_id, soft_failures, started_at, completed_at; ``snapshots``: run_id, n_fields, one row per
    object found. Snapshots are counted before the join, however many one run holds.
    """
    totals = snapshots.groupBy("run_id").agg(
        F.count("*").alias("objects"), F.sum("n_fields").cast("bigint").alias("fields")
    )
    return runs.join(totals, "run_id", "left").select(
        "run_id",
        F.coalesce("objects", F.lit(0)).alias("objects"),
        F.coalesce("fields", F.lit(0)).alias("fields"),
        F.when(F.col("completed_at").isNull(), "running")
        .when(F.col("soft_failures") > 0, "partial")
        .otherwise("completed")
        .alias("status"),
        seconds_between(F.col("started_at"), F.col("completed_at")).alias("duration_seconds"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, independent of the session time zone; null if either is."""
    return (end - start).cast("interval second").cast("bigint")


def provision(snapshots: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects to write after a discovery run: new ones to create, known ones whose structure changed.

    Both sides are keyed by ``name`` and carry ``structure`` (comparable text of the structural metadata).
    """
    known = objects.select(F.col("name").alias("_known"), F.col("structure").alias("_old"))
    joined = snapshots.join(known, F.col("name") == F.col("_known"), "left")
    changed = F.col("structure").isNotNull() & ~F.col("structure").eqNullSafe(F.col("_old"))
    return joined.select(
        "name", F.when(F.col("_known").isNull(), "create").when(changed, "update").alias("action"), "structure"
    ).where("action IS NOT NULL")
