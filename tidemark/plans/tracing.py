"""Registered queries: lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.plans.registry import Inputs, query
from tidemark.session import scratch_path


def _mappings(t: Inputs) -> DataFrame:
    """One mapping per order: its customer's columns into the order's."""
    expression = F.when(F.col("o_orderstatus") == "F", "ROUND(acctbal, 2)").otherwise("")
    return t.orders.select(
        (F.col("o_custkey") % 10).alias("pipeline_id"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source_object_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("destination_object_id"),
        F.array(
            F.struct(F.lit("name").alias("source_column"), F.lit("buyer").alias("destination_column"),
                     F.lit("").alias("expression")),
            F.struct(F.lit("acctbal").alias("source_column"), F.lit("balance").alias("destination_column"),
                     expression.alias("expression")),
            F.struct(F.lit("name").alias("source_column"), F.lit("buyer").alias("destination_column"),
                     F.lit("").alias("expression")),
        ).alias("column_mappings"))


_EDGES = """
    SELECT concat('customer_', o_custkey) AS src_object, 'name' AS src_column, concat('order_', o_orderkey) AS dst_object,
           'buyer' AS dst_column, NULL AS expression FROM {orders}
    UNION ALL
    SELECT concat('customer_', o_custkey), 'acctbal', concat('order_', o_orderkey), 'balance',
           CASE WHEN o_orderstatus = 'F' THEN 'ROUND(acctbal, 2)' END FROM {orders}"""


@query("lineage_edges", _EDGES)
def _(t: Inputs) -> DataFrame:
    return lineage.edges(_mappings(t))


@query("lineage_direct", f"SELECT * FROM ({_EDGES}) WHERE expression IS NULL")
def _(t: Inputs) -> DataFrame:
    return lineage.split_direct(lineage.edges(_mappings(t)))[0]


@query("lineage_transformed", f"SELECT * FROM ({_EDGES}) WHERE expression IS NOT NULL")
def _(t: Inputs) -> DataFrame:
    return lineage.split_direct(lineage.edges(_mappings(t)))[1]


_STORES: dict[tuple[str, str], lineage.LineageStore] = {}


def _store(t: Inputs) -> lineage.LineageStore:
    """The edges of a folder's tables, stored once for all queries of an application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORES:
        _STORES[key] = lineage.LineageStore.write(t.lineage_edges, scratch_path(t.spark, "lineage"))
    return _STORES[key]


# Columns of parts that were returned somewhere, and the regions at the other end.
_PART_STARTS = "SELECT DISTINCT 'part' AS object_id, concat('p', CAST(p_partkey AS STRING)) AS column_name FROM {part} WHERE p_size >= 49"
_REGION_STARTS = "SELECT 'region' AS object_id, concat('r', CAST(r_regionkey AS STRING)) AS column_name FROM {region} WHERE r_name IN ('ASIA', 'EUROPE')"
_NATION_STARTS = "SELECT 'nation' AS object_id, concat('n', CAST(n_nationkey AS STRING)) AS column_name FROM {nation} WHERE n_regionkey = 0 UNION ALL SELECT 'nation', 'unknown'"


def _closure(starts: str, direction: str) -> str:
    near, far = ("src", "dst") if direction == "downstream" else ("dst", "src")
    return f"""
        WITH RECURSIVE walk(object_id, column_name, depth) AS (
            SELECT object_id, column_name, CAST(0 AS BIGINT) FROM ({starts})
            UNION
            SELECT e.{far}_object, e.{far}_column, w.depth + 1
            FROM walk w JOIN {{lineage_edges}} e ON e.{near}_object = w.object_id AND e.{near}_column = w.column_name)
        SELECT object_id, column_name, min(depth) AS depth FROM walk GROUP BY object_id, column_name HAVING min(depth) > 0"""


@query("lineage_upstream", f"""
    WITH RECURSIVE walk(object_id, column_name, depth) AS (
        SELECT object_id, column_name, CAST(0 AS BIGINT) FROM ({_PART_STARTS})
        UNION
        SELECT e.src_object, e.src_column, w.depth + 1
        FROM walk w JOIN {{lineage_edges}} e ON e.dst_object = w.object_id AND e.dst_column = w.column_name)
    SELECT w.object_id, w.column_name, min(depth) AS depth, any_value(i.expression) AS transformation
    FROM walk w LEFT JOIN (SELECT dst_object, dst_column, min(expression) AS expression FROM {{lineage_edges}} GROUP BY 1, 2) i
         ON i.dst_object = w.object_id AND i.dst_column = w.column_name
    GROUP BY w.object_id, w.column_name HAVING min(depth) > 0""")
def _(t: Inputs) -> DataFrame:
    traced = lineage.trace(_store(t), t.sql(_PART_STARTS), "upstream")
    return lineage.with_transformation(traced, _store(t))


@query("lineage_downstream", _closure(_REGION_STARTS, "downstream"))
def _(t: Inputs) -> DataFrame:
    return lineage.trace(_store(t), t.sql(_REGION_STARTS), "downstream")


@query("lineage_both", f"""
    SELECT *, 'upstream' AS direction FROM ({_closure(_NATION_STARTS, 'upstream')})
    UNION ALL SELECT *, 'downstream' FROM ({_closure(_NATION_STARTS, 'downstream')})""")
def _(t: Inputs) -> DataFrame:
    return lineage.trace(_store(t), t.sql(_NATION_STARTS), "both")


def _order_part_mappings(t: Inputs) -> DataFrame:
    """Customer to order to part mappings, one pipeline per ship line status."""
    first = t.orders.select(
        F.lit("orders").alias("pipeline_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_object_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("destination_object_id"))
    second = t.lineitem.select(
        F.col("l_linestatus").alias("pipeline_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_object_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("destination_object_id")).distinct()
    return first.unionByName(second)


@query("lineage_neighbourhood", """
    WITH s AS (SELECT c_custkey FROM {customer} WHERE c_acctbal > 9800),
         o AS (SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM s))
    SELECT 'orders' AS pipeline_id, concat('c', o_custkey) AS source_object_id, concat('o', o_orderkey) AS destination_object_id
    FROM o
    UNION ALL
    SELECT DISTINCT l_linestatus, concat('o', l_orderkey), concat('p', l_partkey) FROM {lineitem}
    WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def _(t: Inputs) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9800").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("object_id"))
    return lineage.neighbourhood(_order_part_mappings(t), rich, "downstream").select(*lineage.MAPPING_KEY)


@query("lineage_upsert", """
    SELECT o_custkey % 10 AS pipeline_id, concat('customer_', o_custkey) AS source_object_id,
           concat('order_', o_orderkey) AS destination_object_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 3 END AS n_columns FROM {orders}
    UNION ALL
    SELECT -1, concat('customer_', o_custkey), concat('order_', o_orderkey), 1 FROM {orders} WHERE o_orderpriority = '2-HIGH'""")
def _(t: Inputs) -> DataFrame:
    current = _mappings(t)
    slim = current.withColumn("column_mappings", F.slice("column_mappings", 1, 1))
    keyed = t.orders.select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("destination_object_id"),
                            "o_orderpriority")
    new = slim.join(keyed, "destination_object_id").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
        F.when(F.col("o_orderpriority") == "2-HIGH", -1).otherwise(F.col("pipeline_id")).alias("pipeline_id"),
        "source_object_id", "destination_object_id", "column_mappings")
    return lineage.upsert(current, new).select(
        *lineage.MAPPING_KEY, F.size("column_mappings").alias("n_columns"))


@query("lineage_raw", """
    SELECT a.object_id AS src_object, a.name AS src_column, b.object_id AS dst_object, b.name AS dst_column,
           CAST(NULL AS VARCHAR) AS expression
    FROM {fields_before} a JOIN {fields_after} b ON a.object_id = b.object_id AND a.name = b.name""")
def _(t: Inputs) -> DataFrame:
    before, after = t.fields_before, t.fields_after
    links = before.select(F.col("object_id").alias("src_object")).distinct().withColumn("dst_object", F.col("src_object"))
    return lineage.raw_lineage(before, after, links)


_TAGGED = """
    SELECT 'customer' AS object_id, concat('c', CAST(c_custkey AS STRING)) AS column_name,
           CASE WHEN c_acctbal > 9000 THEN 'RESTRICTED' ELSE 'PII' END AS tag
    FROM {customer} WHERE c_mktsegment = 'BUILDING'"""


@query("lineage_pii_reach", f"""
    WITH RECURSIVE walk(object_id, column_name, tag, depth) AS (
        SELECT object_id, column_name, tag, CAST(0 AS BIGINT) FROM ({_TAGGED})
        UNION
        SELECT e.dst_object, e.dst_column, w.tag, w.depth + 1
        FROM walk w JOIN {{lineage_edges}} e ON e.src_object = w.object_id AND e.src_column = w.column_name)
    SELECT tag, object_id, column_name, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0""")
def _(t: Inputs) -> DataFrame:
    return lineage.tag_reach(_store(t), t.sql(_TAGGED))


# Tags on three levels, so that tagged columns feed tagged ones.
_TAGGED_TWICE = """
    SELECT 'nation' AS object_id, concat('n', CAST(n_nationkey AS STRING)) AS column_name, 'PII' AS tag FROM {nation} WHERE n_regionkey < 2
    UNION ALL SELECT 'customer', concat('c', CAST(c_custkey AS STRING)), CASE WHEN c_nationkey < 12 THEN 'PII' ELSE 'RESTRICTED' END
    FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000
    UNION ALL SELECT 'orders', concat('o', CAST(o_orderkey AS STRING)), 'RESTRICTED' FROM {orders} WHERE o_totalprice > 480000"""


@query("lineage_tagged_by_tagged", f"""
    WITH RECURSIVE tagged AS (SELECT DISTINCT * FROM ({_TAGGED_TWICE})),
    walk(start_object, start_column, object_id, column_name, tag, depth) AS (
        SELECT object_id, column_name, object_id, column_name, tag, CAST(0 AS BIGINT) FROM tagged
        UNION
        SELECT w.start_object, w.start_column, e.dst_object, e.dst_column, w.tag, w.depth + 1
        FROM walk w JOIN {{lineage_edges}} e ON e.src_object = w.object_id AND e.src_column = w.column_name)
    SELECT tag, object_id, column_name, min(depth) AS depth FROM walk
    WHERE NOT (start_object = object_id AND start_column = column_name) GROUP BY ALL""")
def _(t: Inputs) -> DataFrame:
    return lineage.tag_reach(_store(t), t.sql(_TAGGED_TWICE))


# Lines of returned parts come last, when the lineage of the regions is already known.
@query("lineage_extended", _closure(_REGION_STARTS, "downstream"))
def _(t: Inputs) -> DataFrame:
    late = F.col("expression").eqNullSafe(F.lit("SUM(quantity)")) | (F.col("dst_object") == "customer") & F.col("dst_column").endswith("7")
    store = lineage.LineageStore.write(_store(t).edges().where(~late), scratch_path(t.spark, "lineage"))
    starts = t.sql(_REGION_STARTS)
    traced = lineage.trace(store, starts, "downstream")
    added = _store(t).edges().where(late)
    store.add(added)
    return lineage.extend(traced, starts, store, added, "downstream")


@query("lineage_lookup", """
    SELECT 'orders' AS pipeline_id, concat('c', o_custkey) AS source_object_id,
           concat('o', o_orderkey) AS destination_object_id FROM {orders}""")
def _(t: Inputs) -> DataFrame:
    return lineage.lookup(_order_part_mappings(t), pipeline_id="orders")


@query("lineage_by_destination", """
    SELECT DISTINCT l_linestatus AS pipeline_id, concat('o', l_orderkey) AS source_object_id, 'p1' AS destination_object_id
    FROM {lineitem} WHERE l_partkey = 1""")
def _(t: Inputs) -> DataFrame:
    return lineage.lookup(_order_part_mappings(t), destination="p1")


@query("lineage_urns", f"""
    SELECT concat('urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:postgres,', src_object, ',PROD),', src_column, ')')
               AS upstream,
           concat('urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:postgres,', dst_object, ',PROD),', dst_column, ')')
               AS downstream, expression AS transform_operation, CAST(1.0 AS DOUBLE) AS confidence
    FROM ({_EDGES})""")
def _(t: Inputs) -> DataFrame:
    return lineage.urn_edges(lineage.edges(_mappings(t)), "postgres")


@query("lineage_type_classes", """
    SELECT object_id, name, CASE WHEN normalized_type IN ('integer', 'bigint', 'decimal', 'float') THEN 'number'
                                 ELSE 'string' END AS type_class FROM {fields_after}""")
def _(t: Inputs) -> DataFrame:
    return t.fields_after.select("object_id", "name", lineage.type_class(F.col("normalized_type")).alias("type_class"))


@query("lineage_roots_leaves", """
    WITH s AS (SELECT DISTINCT src_object AS object_id, src_column AS column_name FROM {lineage_edges}),
         d AS (SELECT DISTINCT dst_object AS object_id, dst_column AS column_name FROM {lineage_edges})
    SELECT *, 'root' AS role FROM (SELECT * FROM s EXCEPT SELECT * FROM d)
    UNION ALL SELECT *, 'leaf' FROM (SELECT * FROM d EXCEPT SELECT * FROM s)""")
def _(t: Inputs) -> DataFrame:
    return lineage.roots_and_leaves(t.lineage_edges)
