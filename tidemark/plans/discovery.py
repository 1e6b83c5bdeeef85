"""Registered queries: schema discovery, typing, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import TYPE_MAP, UNMAPPED, normalize_types
from tidemark.operators import contract, drift, infer, schema, tags
from tidemark.plans.inputs import TABLES
from tidemark.plans.ingestion import _CANONICAL_SQL, _TABLE_LIST
from tidemark.plans.registry import Inputs, query

# Keys of the given tables.
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
_PK_SQL = " OR ".join(
    f"(table_name = '{table}' AND column_name = '{column}')" for table, names in PRIMARY_KEYS.items() for column in names
)


@query("schema_fields_all", f"""
    SELECT table_name AS object_id, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS name,
           {_CANONICAL_SQL} AS normalized_type, true AS nullable, coalesce({_PK_SQL}, false) AS is_primary_key,
           '' AS description
    FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})""")
def _(t: Inputs) -> DataFrame:
    return schema.snapshot({name: getattr(t, name) for name in TABLES}, PRIMARY_KEYS).drop("source_type")


# Every part declares a type of one of the four systems; some are unknown, some have a format.
_DECLARED_TYPES = """
    SELECT p_partkey, system, type,
           CASE WHEN system = 'openapi' THEN @at(@list('', 'int64', 'date', 'double', 'date-time', 'ipv4'),
                CAST(p_partkey % 6 + 1 AS INT)) ELSE '' END AS format
    FROM (SELECT p_partkey, system,
                 CASE system
                   WHEN 'relational' THEN @at(@list('BigInteger', 'Numeric', 'DateTime', 'Uuid', 'Inet', 'Text', 'JSON'), i)
                   WHEN 'bson' THEN @at(@list('int', 'long', 'decimal', 'objectId', 'array', 'regex', 'binData'), i)
                   WHEN 'openapi' THEN @at(@list('integer', 'number', 'string', 'array', 'string', 'file', 'boolean'), i)
                   ELSE @at(@list('str', 'int', 'float', 'dict', 'NoneType', 'bool', 'list'), i) END AS type
          FROM (SELECT p_partkey, @at(@list('relational', 'bson', 'openapi', 'sample'), CAST(p_size % 4 + 1 AS INT))
                       AS system, CAST(floor(p_partkey / 4) % 7 + 1 AS INT) AS i FROM {part}) a) b"""

_MAP_VALUES = ", ".join(f"('{s}', '{k}', '{f}', '{n}')" for (s, k, f), n in TYPE_MAP.items())
_UNMAPPED_CASE = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in UNMAPPED.items())


@query("normalize_types", f"""
    WITH m(system, type, format, normalized) AS (VALUES {_MAP_VALUES})
    SELECT d.p_partkey, d.system, d.type, d.format,
           coalesce(a.normalized, b.normalized, CASE d.system {_UNMAPPED_CASE} END) AS normalized_type
    FROM ({_DECLARED_TYPES}) d
    LEFT JOIN m a ON a.system = d.system AND a.type = d.type AND a.format = d.format
    LEFT JOIN m b ON b.system = d.system AND b.type = d.type AND b.format = ''""")
def _(t: Inputs) -> DataFrame:
    return normalize_types(t.sql(_DECLARED_TYPES))


@query("scope_filter", """
    SELECT c_mktsegment AS namespace, c_name AS name FROM {customer}
    WHERE (c_mktsegment = 'BUILDING' OR regexp_full_match(c_name, 'Customer#.*[13]') OR c_name LIKE 'Customer#000000__0')
      AND NOT (c_name LIKE '%7_' OR c_mktsegment = 'MACHINERY' AND c_name LIKE '%1')""")
def _(t: Inputs) -> DataFrame:
    objects = t.customer.select(F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("name"))
    return schema.scope_filter(
        objects, ["BUILDING.*", "Customer#*[13]", "Customer#000000??0", "customer#*"], ["*7?", "MACHINERY.*1"])


@query("scope_filter_relational", """
    SELECT c_mktsegment AS namespace, c_name AS name FROM {customer}
    WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND c_name = 'Customer#000000001')""")
def _(t: Inputs) -> DataFrame:
    objects = t.customer.select(F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("name"))
    return schema.scope_filter(
        objects, ["BUILDING.*", "MACHINERY.Customer#000000001", "HOUSEHOLD.Cust*", "Customer#000000003"], ["*1"],
        mode="relational")


def _order_documents(t: Inputs) -> DataFrame:
    """Orders as documents of one collection per priority: mixed types, a null-only key, nested values."""
    status = F.col("o_orderstatus")
    price = F.when(status == "P", F.lit('"n/a"')).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    ref = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("null")).otherwise(F.col("o_custkey").cast("string"))
    body = F.concat(
        F.lit('{"_id": "x'), F.col("o_orderkey").cast("string"), F.lit('", "key": '),
        F.col("o_orderkey").cast("string"),
        F.lit(', "price": '), price, F.lit(', "note": null, "customer": '), ref,
        F.lit(', "open": '), (status == "O").cast("string"),
        F.lit(', "tags": ["a", "b"], "nested": {"status": "'), status, F.lit('"}'),
        F.when(status == "F", F.lit(', "closed_by": "clerk"}')).otherwise(F.lit("}")),
    )
    return t.orders.select(F.col("o_orderpriority").alias("collection"), body.alias("body"))


@query("infer_json_fields", """
    WITH f AS (
      SELECT o_orderpriority AS object_id, unnest([
          {'name': 'key', 'type': 'int'},
          {'name': 'price', 'type': CASE WHEN o_orderstatus = 'P' THEN 'str' ELSE 'float' END},
          {'name': 'note', 'type': 'NoneType'},
          {'name': 'customer', 'type': CASE WHEN o_orderpriority = '1-URGENT' THEN 'NoneType' ELSE 'int' END},
          {'name': 'open', 'type': 'bool'}, {'name': 'tags', 'type': 'list'}, {'name': 'nested', 'type': 'dict'},
          {'name': CASE WHEN o_orderstatus = 'F' THEN 'closed_by' END, 'type': 'str'}], recursive := true)
      FROM {orders}),
    g AS (SELECT object_id, name, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'str' END AS type, count(*) AS documents
          FROM f WHERE name IS NOT NULL GROUP BY object_id, name)
    SELECT object_id, name, concat('python:', type) AS source_type,
           CASE type WHEN 'int' THEN 'integer' WHEN 'float' THEN 'float' WHEN 'bool' THEN 'boolean'
                     WHEN 'list' THEN 'json' WHEN 'dict' THEN 'json' ELSE 'string' END AS normalized_type,
           true AS nullable, false AS is_primary_key, documents
    FROM g""")
def _(t: Inputs) -> DataFrame:
    return infer.infer_json_fields(_order_documents(t), "body", "collection")


def _nested_documents(t: Inputs) -> DataFrame:
    """Orders as documents with objects in lists and lists in objects; every fiftieth cannot be read."""
    vip = F.when(F.col("o_orderstatus") == "P", "null").otherwise("true")
    second = F.when(F.col("o_orderkey") % 1000 == 1, '"x"').otherwise("2")
    body = F.concat(
        F.lit('{"key": '), F.col("o_orderkey").cast("string"), F.lit(', "buyer": {"id": '), F.col("o_custkey").cast("string"),
        F.lit(', "vip": '), vip, F.lit('}, "lines": [{"no": 1, "price": 1.5}, {"no": '), second,
        F.lit('}], "codes": [1, 2.5], "empty": [], "a.b": {"_id": "x"}}'))
    broken = F.col("o_orderkey") % 50 == 0
    return t.orders.select(F.col("o_orderpriority").alias("collection"), F.when(broken, '{"key": ').otherwise(body).alias("body"))


@query("infer_nested_fields", """
    WITH d AS (SELECT o_orderpriority AS object_id, count(*) AS documents, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS unreadable
               FROM {orders} GROUP BY 1),
         v AS (SELECT o_orderpriority AS object_id, unnest([
                 {'path': 'key', 'type': 'int', 'n': 1}, {'path': 'buyer', 'type': 'dict', 'n': 1}, {'path': 'buyer.id', 'type': 'int', 'n': 1},
                 {'path': 'buyer.vip', 'type': CASE WHEN o_orderstatus = 'P' THEN 'NoneType' ELSE 'bool' END, 'n': 1},
                 {'path': 'lines', 'type': 'list', 'n': 1}, {'path': 'lines[]', 'type': 'dict', 'n': 2},
                 {'path': 'lines[].no', 'type': 'int', 'n': 1},
                 {'path': 'lines[].no', 'type': CASE WHEN o_orderkey % 1000 = 1 THEN 'str' ELSE 'int' END, 'n': 1},
                 {'path': 'lines[].price', 'type': 'float', 'n': 1}, {'path': 'codes', 'type': 'list', 'n': 1},
                 {'path': 'codes[]', 'type': 'int', 'n': 1}, {'path': 'codes[]', 'type': 'float', 'n': 1}, {'path': 'empty', 'type': 'list', 'n': 1},
                 {'path': '`a.b`', 'type': 'dict', 'n': 1}, {'path': '`a.b`._id', 'type': 'str', 'n': 1}], recursive := true)
               FROM {orders} WHERE o_orderkey % 50 <> 0),
         g AS (SELECT object_id, path, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'str' END AS type, CAST(sum(n) AS BIGINT) AS observed
               FROM v GROUP BY 1, 2)
    SELECT object_id, path, concat('python:', type) AS source_type,
           CASE type WHEN 'int' THEN 'integer' WHEN 'float' THEN 'float' WHEN 'bool' THEN 'boolean' WHEN 'list' THEN 'json'
                     WHEN 'dict' THEN 'json' ELSE 'string' END AS normalized_type, observed, documents, unreadable
    FROM g JOIN d USING (object_id)""")
def _(t: Inputs) -> DataFrame:
    return infer.infer_nested_fields(_nested_documents(t), "body", "collection")


@query("infer_json_fields_events", """
    SELECT event_type AS object_id, unnest(json_keys(any_value(props))) AS name, 'python:int' AS source_type,
           'integer' AS normalized_type, true AS nullable, false AS is_primary_key, count(*) AS documents
    FROM {events} GROUP BY event_type""")
def _(t: Inputs) -> DataFrame:
    return infer.infer_json_fields(t.events, "props", "event_type")


def _resource_pages(t: Inputs) -> DataFrame:
    """Suppliers and customers of each nation as pages; the first page holds the smallest key."""
    item = F.concat(
        F.lit('{"ID": '), F.col("c_custkey").cast("string"), F.lit(', "name": "'), F.col("c_name"),
        F.lit('", "balance": '),
        F.when(F.col("c_acctbal") < 0, F.lit("null")).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")),
        F.lit(', "segment": {"code": "'), F.col("c_mktsegment"), F.lit('"}}'),
    )
    body = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"results": ['), item, F.lit(', {"other": 1}]}'))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("["), item, F.lit("]"))).otherwise(item)
    return t.customer.select(F.col("c_nationkey").alias("resource"), F.col("c_custkey").alias("page"),
                             body.alias("body"))


@query("infer_first_item", """
    WITH first AS (SELECT c_nationkey AS object_id, arg_min(c_acctbal, c_custkey) AS bal FROM {customer} GROUP BY 1)
    SELECT object_id, unnest([
        {'name': 'ID', 'source_type': 'python:int', 'normalized_type': 'integer', 'nullable': true, 'is_primary_key': true},
        {'name': 'name', 'source_type': 'python:str', 'normalized_type': 'string', 'nullable': true,
         'is_primary_key': false},
        {'name': 'balance', 'source_type': CASE WHEN bal < 0 THEN 'python:NoneType' ELSE 'python:float' END,
         'normalized_type': CASE WHEN bal < 0 THEN 'string' ELSE 'float' END, 'nullable': true, 'is_primary_key': false},
        {'name': 'segment', 'source_type': 'python:dict', 'normalized_type': 'json', 'nullable': true,
         'is_primary_key': false}], recursive := true)
    FROM first""")
def _(t: Inputs) -> DataFrame:
    return infer.infer_first_item(_resource_pages(t), "body", "resource", "page")


def _validators(t: Inputs) -> DataFrame:
    """One document validator per part."""
    size = F.col("p_size")
    size_type = F.when(size % 3 == 0, F.lit('"int"')).when(size % 3 == 1, F.lit('["null", "long"]')).otherwise(
        F.lit('["null"]'))
    required = F.when(size > 25, F.lit('["brand", "size"]')).otherwise(F.lit('["brand"]'))
    spec = F.concat(
        F.lit('{"properties": {"brand": {"bsonType": "string"}, "size": {"bsonType": '), size_type,
        F.lit('}, "price": {"bsonType": "'), F.when(size % 2 == 0, F.lit("decimal")).otherwise(F.lit("timestamp")),
        F.lit('"}, "free": {"minimum": 0}}, "required": '), required, F.lit("}"),
    )
    return t.part.select("p_partkey", spec.alias("spec"))


_VALIDATOR_SQL = """
    SELECT p_partkey AS object_id, unnest([
        {'name': 'brand', 'source_type': 'bson:string', 'normalized_type': 'string', 'nullable': false,
         'is_primary_key': false},
        {'name': 'size', 'source_type': CASE p_size % 3 WHEN 0 THEN 'bson:int' WHEN 1 THEN 'bson:long'
                                        ELSE 'bson:string' END,
         'normalized_type': CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'bigint' ELSE 'string' END,
         'nullable': p_size <= 25, 'is_primary_key': false},
        {'name': 'price', 'source_type': CASE WHEN p_size % 2 = 0 THEN 'bson:decimal' ELSE 'bson:timestamp' END,
         'normalized_type': CASE WHEN p_size % 2 = 0 THEN 'decimal' ELSE 'string' END, 'nullable': true,
         'is_primary_key': false},
        {'name': 'free', 'source_type': 'bson:string', 'normalized_type': 'string', 'nullable': true,
         'is_primary_key': false}], recursive := true)
    FROM {part}"""


@query("fields_from_json_schema", _VALIDATOR_SQL)
def _(t: Inputs) -> DataFrame:
    return infer.fields_from_json_schema(_validators(t), "spec", "p_partkey")


def _api_specs(t: Inputs) -> DataFrame:
    """One API description per customer, with two component schemas."""
    key = F.col("c_custkey")
    number_format = F.when(key % 3 == 0, F.lit(', "format": "double"')).when(
        key % 3 == 1, F.lit(', "format": "weird"')).otherwise(F.lit(""))
    spec = F.concat(
        F.lit('{"components": {"schemas": {"Customer": {"properties": {"Id": {"type": "integer", "format": "int64"}, '
              '"balance": {"type": "number"'), number_format,
        F.lit(', "description": "money held"}, "since": {"type": "string", "format": "date-time"}, "any": {}}, '
              '"required": ["Id"'), F.when(key % 2 == 0, F.lit(', "since"')).otherwise(F.lit("")),
        F.lit(']}, "Internal": {"properties": {"x": {"type": "string"}}}, "CustomerKey": {"properties": '
              '{"code": {"type": "string", "x-primary-key": true}}}}}}'),
    )
    return t.customer.select("c_custkey", spec.alias("spec"))


_API_SQL = """
    SELECT c_custkey AS object_id, unnest([
        {'schema_name': 'Customer', 'name': 'Id', 'source_type': 'openapi:integer(int64)', 'normalized_type': 'bigint',
         'nullable': false, 'is_primary_key': true, 'description': NULL},
        {'schema_name': 'Customer', 'name': 'balance', 'source_type': CASE c_custkey % 3 WHEN 0 THEN 'openapi:number(double)'
            WHEN 1 THEN 'openapi:number(weird)' ELSE 'openapi:number' END,
         'normalized_type': CASE WHEN c_custkey % 3 = 0 THEN 'decimal' ELSE 'float' END, 'nullable': true,
         'is_primary_key': false, 'description': 'money held'},
        {'schema_name': 'Customer', 'name': 'since', 'source_type': 'openapi:string(date-time)',
         'normalized_type': 'timestamp', 'nullable': c_custkey % 2 <> 0, 'is_primary_key': false, 'description': NULL},
        {'schema_name': 'Customer', 'name': 'any', 'source_type': 'openapi:string', 'normalized_type': 'string',
         'nullable': true, 'is_primary_key': false, 'description': NULL},
        {'schema_name': 'CustomerKey', 'name': 'code', 'source_type': 'openapi:string', 'normalized_type': 'string',
         'nullable': true, 'is_primary_key': true, 'description': NULL}], recursive := true)
    FROM {customer}"""


@query("fields_from_openapi", _API_SQL)
def _(t: Inputs) -> DataFrame:
    return infer.fields_from_openapi(_api_specs(t), "spec", "c_custkey", ["Customer*"])


@query("discover_hybrid", f"""
    WITH declared AS ({_VALIDATOR_SQL}),
    sampled AS (
        SELECT p_partkey AS object_id, unnest([
            {{'name': 'brand', 'source_type': 'python:str', 'normalized_type': 'string'}},
            {{'name': 'size', 'source_type': 'python:int', 'normalized_type': 'integer'}}], recursive := true)
        FROM {{part}} WHERE p_retailprice >= 1000)
    SELECT d.object_id, name, source_type, normalized_type, nullable, is_primary_key, 'declared' AS discovery_method
    FROM declared d JOIN {{part}} ON p_partkey = d.object_id WHERE p_retailprice < 1000
    UNION ALL
    SELECT object_id, name, source_type, normalized_type, true, false, 'payload_sampling' FROM sampled""")
def _(t: Inputs) -> DataFrame:
    # Cheap parts have a validator, all parts have documents.
    cheap = t.part.where("p_retailprice < 1000").select("p_partkey")
    declared = infer.fields_from_json_schema(_validators(t).join(cheap, "p_partkey", "left_semi"), "spec", "p_partkey")
    document = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    sampled = infer.infer_json_fields(t.part.select("p_partkey", document.alias("body")), "body", "p_partkey")
    return infer.discover(declared, sampled)


def _structures(t: Inputs) -> DataFrame:
    """Structural metadata of one object per customer."""
    key = F.col("c_custkey")

    def texts(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    return t.customer.select(
        F.concat(F.lit("t"), key.cast("string")).alias("object_id"),
        F.when(key % 2 == 0, texts("id", "line")).otherwise(texts("id")).alias("primary_key"),
        F.array(
            F.struct(F.when(key % 5 != 0, F.lit("ix_status")).alias("name"), texts("status", "day").alias("columns"),
                     (key % 3 == 0).alias("unique"))
        ).alias("indexes"),
        F.array(
            F.struct(F.when(key % 7 != 0, F.lit("fk_parent")).alias("name"),
                     texts("parent_id", "parent_line").alias("constrained_columns"),
                     F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("referred_table"),
                     texts("id", "line").alias("referred_columns"))
        ).alias("foreign_keys"),
    )


@query("flatten_constraints", """
    SELECT concat('t', c_custkey) AS object_id, kind, constraint_name, CAST(position AS INTEGER) AS position, "column",
           is_unique, referred_table, referred_column
    FROM (
      SELECT c_custkey, 'primary_key' AS kind, 'primary_key' AS constraint_name, 0 AS position, 'id' AS "column",
             true AS is_unique, NULL AS referred_table, NULL AS referred_column FROM {customer}
      UNION ALL SELECT c_custkey, 'primary_key', 'primary_key', 1, 'line', true, NULL, NULL FROM {customer}
                WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey, 'index', 'ix_status', 0, 'status', c_custkey % 3 = 0, NULL, NULL FROM {customer}
                WHERE c_custkey % 5 <> 0
      UNION ALL SELECT c_custkey, 'index', 'ix_status', 1, 'day', c_custkey % 3 = 0, NULL, NULL FROM {customer}
                WHERE c_custkey % 5 <> 0
      UNION ALL SELECT c_custkey, 'foreign_key', CASE WHEN c_custkey % 7 <> 0 THEN 'fk_parent' ELSE 'unnamed_fk' END, 0,
                'parent_id', false, concat('p', c_nationkey), 'id' FROM {customer}
      UNION ALL SELECT c_custkey, 'foreign_key', CASE WHEN c_custkey % 7 <> 0 THEN 'fk_parent' ELSE 'unnamed_fk' END, 1,
                'parent_line', false, concat('p', c_nationkey), 'line' FROM {customer})""")
def _(t: Inputs) -> DataFrame:
    return schema.flatten_constraints(_structures(t))


# The catalogue of a database with a table for every object of the later capture; every fifth table has a null schema.
_SCHEMA = "CASE WHEN length(object_id) % 5 = 0 THEN NULL ELSE 'lake' END"
_CATALOG = {
    "columns": f"""
        SELECT {_SCHEMA} AS table_schema, object_id AS table_name, ordinal AS ordinal_position, name AS column_name,
               CASE normalized_type WHEN 'float' THEN 'double precision' WHEN 'decimal' THEN 'numeric' WHEN 'string' THEN 'text'
                                    ELSE normalized_type END AS data_type,
               CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable, description AS column_comment FROM {{fields_after}}""",
    # Two keys of two columns where the columns are there, listed against their order.
    "keys": f"""
        SELECT {_SCHEMA} AS table_schema, object_id AS table_name, 'pk' AS constraint_name, 'PRIMARY KEY' AS constraint_type,
               CASE name WHEN 'f0' THEN 2 ELSE 1 END AS ordinal_position, name AS column_name, CAST(NULL AS STRING) AS referred_table,
               CAST(NULL AS STRING) AS referred_column FROM {{fields_after}} WHERE name IN ('f0', 'f2')
        UNION ALL
        SELECT {_SCHEMA}, object_id, concat('fk_', CASE WHEN name = 'f4' THEN 'b' ELSE 'a' END), 'FOREIGN KEY',
               CASE name WHEN 'f1' THEN 2 ELSE 1 END, name, concat('parent_', CASE WHEN name = 'f4' THEN 'b' ELSE 'a' END), concat('p', name)
        FROM {{fields_after}} WHERE name IN ('f1', 'f3', 'f4')
        UNION ALL
        SELECT {_SCHEMA}, object_id, 'fk_c', 'FOREIGN KEY', 1, name, 'parent_c', 'id' FROM {{fields_after}} WHERE name = 'f3'""",
    "indexes": f"""
        SELECT {_SCHEMA} AS table_schema, object_id AS table_name, CASE WHEN length(object_id) % 3 <> 0 THEN 'ix_wide' END AS index_name,
               length(object_id) % 2 = 0 AS is_unique, ordinal AS ordinal_position, name AS column_name
        FROM {{fields_after}} WHERE name IN ('f1', 'f2')
        UNION ALL SELECT {_SCHEMA}, object_id, 'ix_one', false, 1, name FROM {{fields_after}} WHERE name = 'f2'""",
    "tables": f"""
        SELECT DISTINCT {_SCHEMA} AS table_schema, object_id AS table_name, concat('about ', object_id) AS table_comment,
               CAST(length(object_id) AS BIGINT) AS row_estimate FROM {{fields_after}}
        UNION ALL SELECT 'lake', 'no_columns', NULL, 0""",
}
_CATALOG_ID = "concat_ws('.', table_schema, table_name)"


def _from_catalog(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return schema.snapshot_from_catalog(*[t.sql(_CATALOG[name]) for name in ("columns", "keys", "indexes", "tables")])


@query("snapshot_from_catalog", f"""
    WITH c AS (SELECT *, {_CATALOG_ID} AS object_id FROM ({_CATALOG['columns']})),
         k AS (SELECT *, {_CATALOG_ID} AS object_id FROM ({_CATALOG['keys']})),
         i AS (SELECT *, {_CATALOG_ID} AS object_id FROM ({_CATALOG['indexes']}))
    SELECT object_id, CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name, data_type AS source_type,
           CASE lower(data_type) WHEN 'integer' THEN 'integer' WHEN 'bigint' THEN 'bigint' WHEN 'double precision' THEN 'float'
                                 WHEN 'numeric' THEN 'float' WHEN 'text' THEN 'string' WHEN 'uuid' THEN 'uuid' ELSE 'unknown' END AS normalized_type,
           is_nullable <> 'NO' AS nullable,
           EXISTS (SELECT 1 FROM k WHERE k.object_id = c.object_id AND k.column_name = c.column_name AND constraint_type = 'PRIMARY KEY')
               AS is_primary_key, coalesce(column_comment, '') AS description,
           (SELECT arg_max(referred_table, constraint_name) FROM k WHERE k.object_id = c.object_id AND k.column_name = c.column_name
            AND constraint_type = 'FOREIGN KEY') AS fk_to,
           coalesce((SELECT string_agg(index_name, ',' ORDER BY index_name) FROM i WHERE i.object_id = c.object_id
                     AND i.column_name = c.column_name), '') AS indexes
    FROM c""")
def _(t: Inputs) -> DataFrame:
    return _from_catalog(t)[0].withColumn("indexes", F.array_join("indexes", ","))


@query("structures_from_catalog", f"""
    WITH k AS (SELECT *, {_CATALOG_ID} AS object_id FROM ({_CATALOG['keys']})),
         i AS (SELECT *, {_CATALOG_ID} AS object_id FROM ({_CATALOG['indexes']}) WHERE index_name IS NOT NULL)
    SELECT object_id, 'primary_key' AS kind, 'primary_key' AS constraint_name,
           CAST(row_number() OVER (PARTITION BY object_id ORDER BY ordinal_position) - 1 AS INTEGER) AS position, column_name AS "column",
           true AS is_unique, NULL AS referred_table, NULL AS referred_column FROM k WHERE constraint_type = 'PRIMARY KEY'
    UNION ALL
    SELECT object_id, 'index', index_name, CAST(row_number() OVER (PARTITION BY object_id, index_name ORDER BY ordinal_position) - 1 AS INTEGER),
           column_name, is_unique, NULL, NULL FROM i
    UNION ALL
    SELECT object_id, 'foreign_key', constraint_name,
           CAST(row_number() OVER (PARTITION BY object_id, constraint_name ORDER BY ordinal_position) - 1 AS INTEGER), column_name, false,
           referred_table, referred_column FROM k WHERE constraint_type = 'FOREIGN KEY'""")
def _(t: Inputs) -> DataFrame:
    return schema.flatten_constraints(_from_catalog(t)[1])


@query("discovery_summary", """
    SELECT o_orderkey AS run_id, count(*) AS objects, CAST(sum(l_linenumber) AS BIGINT) AS fields,
           CASE WHEN any_value(o_orderstatus) = 'O' THEN 'running' WHEN max(l_tax) > 0.07 THEN 'partial'
                ELSE 'completed' END AS status,
           CASE WHEN any_value(o_orderstatus) <> 'O'
                THEN CAST(date_diff('second', any_value(o_orderdate), max(l_shipdate)) AS BIGINT) END AS duration_seconds
    FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(t: Inputs) -> DataFrame:
    # An order is a run, its lines the objects found, shipping the last one completes it.
    ends = t.lineitem.groupBy("l_orderkey").agg(
        F.max((F.col("l_tax") > 0.07).cast("int")).alias("soft_failures"), F.max("l_shipdate").alias("shipped"))
    runs = ends.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("run_id"), "soft_failures", F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("shipped")).alias("completed_at"))
    found = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n_fields"))
    return schema.discovery_summary(runs, found)


_COLUMN_NAMES = """
    SELECT p_partkey, concat(@at(@list('customer_cpf', 'User_EMAIL', 'endereco', 'first_name', 'created_at',
                                       'Celular', 'senha_hash', 'amount', 'zipcode', 'supplier_cnpj_name'),
                                 CAST(p_partkey % 10 + 1 AS INT)), '_', CAST(p_size AS STRING)) AS name
    FROM {part}"""

_TAG_SQL = f"""
    SELECT p_partkey, name, matched_pattern,
           CASE WHEN matched_pattern IN ('cpf|cnpj', 'password|senha') THEN 'RESTRICTED' ELSE 'PII' END AS suggested_tag,
           CASE WHEN matched_pattern IN ('cpf|cnpj', 'password|senha', 'email') THEN 'high'
                WHEN matched_pattern = 'name|nome' THEN 'low' ELSE 'medium' END AS confidence,
           concat('Auto-suggested based on field name matching ''', matched_pattern, '''') AS auto_generated_description
    FROM (SELECT *, CASE WHEN regexp_matches(name, 'cpf|cnpj', 'i') THEN 'cpf|cnpj'
                         WHEN regexp_matches(name, 'password|senha', 'i') THEN 'password|senha'
                         WHEN regexp_matches(name, 'email', 'i') THEN 'email'
                         WHEN regexp_matches(name, 'phone|telefone|celular', 'i') THEN 'phone|telefone|celular'
                         WHEN regexp_matches(name, 'address|endereco|cep|zipcode', 'i') THEN 'address|endereco|cep|zipcode'
                         WHEN regexp_matches(name, 'name|nome', 'i') THEN 'name|nome' END AS matched_pattern
          FROM ({_COLUMN_NAMES}) c)
    WHERE matched_pattern IS NOT NULL"""


@query("policy_tags_all", _TAG_SQL)
def _(t: Inputs) -> DataFrame:
    return tags.infer_policy_tags(t.sql(_COLUMN_NAMES))


@query("policy_tags_high", f"SELECT * FROM ({_TAG_SQL}) WHERE confidence = 'high'")
def _(t: Inputs) -> DataFrame:
    return tags.infer_policy_tags(t.sql(_COLUMN_NAMES), confidence="high")


_TAGGED_ASSETS = """
    SELECT n_nationkey AS asset_id, CASE WHEN n_regionkey = 1 THEN 'PII' END AS asset_tag FROM {nation}"""
_TAGGED_OBJECTS = """
    SELECT c_custkey AS object_id, c_nationkey AS asset_id,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'RESTRICTED' WHEN c_mktsegment = 'FURNITURE' THEN 'INTERNAL'
           END AS object_tag FROM {customer}"""
_TAGGED_ELEMENTS = """
    SELECT o_custkey AS object_id, o_orderkey AS name, CASE WHEN o_orderpriority = '5-LOW' THEN 'PUBLIC' END AS element_tag
    FROM {orders}"""


@query("effective_tags", f"""
    SELECT e.object_id, e.name, coalesce(element_tag, object_tag, asset_tag) AS effective_tag,
           CASE WHEN element_tag IS NOT NULL THEN 'element' WHEN object_tag IS NOT NULL THEN 'object'
                WHEN asset_tag IS NOT NULL THEN 'asset' ELSE 'none' END AS inherited_from
    FROM ({_TAGGED_ELEMENTS}) e LEFT JOIN ({_TAGGED_OBJECTS}) o ON o.object_id = e.object_id
    LEFT JOIN ({_TAGGED_ASSETS}) a ON a.asset_id = o.asset_id""")
def _(t: Inputs) -> DataFrame:
    assets, objects, elements = (
        t.sql(sql) for sql in (_TAGGED_ASSETS, _TAGGED_OBJECTS, _TAGGED_ELEMENTS))
    return tags.effective_tags(assets, objects, elements)


@query("provision_missing", """
    WITH b AS (SELECT object_id, count(*) AS n FROM {fields_before} GROUP BY object_id),
         a AS (SELECT object_id, count(*) AS n FROM {fields_after} GROUP BY object_id)
    SELECT a.object_id AS name, CASE WHEN b.n IS NULL THEN 'create' ELSE 'update' END AS action,
           concat('columns:', a.n) AS structure
    FROM a LEFT JOIN b ON a.object_id = b.object_id WHERE b.n IS NULL OR b.n <> a.n""")
def _(t: Inputs) -> DataFrame:
    def structures(fields: DataFrame) -> DataFrame:
        text = F.concat(F.lit("columns:"), F.count("*").cast("string")).alias("structure")
        return fields.groupBy(F.col("object_id").alias("name")).agg(text)

    return schema.provision(structures(t.fields_after), structures(t.fields_before))


_SNAPSHOT_TYPE = """CASE WHEN normalized_type IN ('string', 'integer', 'bigint', 'float', 'decimal', 'date', 'timestamp',
                         'boolean', 'bytes', 'json') THEN normalized_type ELSE 'string' END"""
_HEALED_SQL = f"""
    SELECT coalesce(e.object_id, s.object_id) AS object_id, coalesce(e.name, s.name) AS name, e.source_type,
           e.destination_type, e.required, e.nullable, e.is_primary_key, e.description,
           s.new_type, s.nullable AS new_nullable, s.description AS new_description,
           CASE WHEN e.object_id IS NULL THEN 'added'
                WHEN s.object_id IS NULL OR (e.destination_type = s.new_type AND e.nullable = s.nullable) THEN 'kept'
                WHEN e.source_type = 'string' AND s.new_type IN ('integer', 'bigint', 'float', 'date', 'timestamp', 'boolean')
                THEN 'refused' ELSE 'updated' END AS action
    FROM {{contract}} e FULL JOIN (SELECT *, {_SNAPSHOT_TYPE} AS new_type FROM {{fields_after}}) s
    ON e.object_id = s.object_id AND e.name = s.name"""


@query("self_heal_elements", f"""
    SELECT object_id, name, coalesce(source_type, new_type) AS source_type,
           CASE WHEN action IN ('added', 'updated') THEN new_type ELSE destination_type END AS destination_type,
           CASE WHEN action IN ('added', 'updated') THEN NOT new_nullable ELSE required END AS required,
           CASE WHEN action IN ('added', 'updated') THEN new_nullable ELSE nullable END AS nullable,
           coalesce(is_primary_key, false) AS is_primary_key, coalesce(description, new_description, '') AS description,
           action
    FROM ({_HEALED_SQL})""")
def _(t: Inputs) -> DataFrame:
    return contract.apply_snapshot(t.contract, t.fields_after)


@query("self_heal_scoped", """
    SELECT DISTINCT a.object_id FROM {fields_after} a
    LEFT JOIN {fields_before} b ON a.object_id = b.object_id AND a.name = b.name
    WHERE a.object_id NOT IN (SELECT object_id FROM {fields_before}) OR b.name IS NULL
       OR (NOT b.nullable AND a.nullable)
       OR (a.normalized_type <> b.normalized_type
           AND (lower(a.normalized_type) = lower(b.normalized_type)
                OR (lower(b.normalized_type) = 'integer' AND a.normalized_type IN ('bigint', 'float', 'decimal'))
                OR (b.normalized_type = 'bigint' AND a.normalized_type IN ('float', 'decimal'))
                OR (b.normalized_type = 'float' AND a.normalized_type = 'decimal')))""")
def _(t: Inputs) -> DataFrame:
    events = drift.with_severity(drift.diff(t.fields_before, t.fields_after))
    return contract.objects_to_heal(t.fields_after, events, has_baseline=True)


@query("destructive_overrides", f"""
    SELECT e.object_id, e.name, e.source_type, new_type AS destination_type
    FROM {{contract}} e JOIN (SELECT *, {_SNAPSHOT_TYPE} AS new_type FROM {{fields_after}}) s
    ON e.object_id = s.object_id AND e.name = s.name
    WHERE e.source_type = 'string' AND new_type IN ('integer', 'bigint', 'float', 'date', 'timestamp', 'boolean')""")
def _(t: Inputs) -> DataFrame:
    found = t.fields_after.select("object_id", "name", contract.as_contract_type(F.col("normalized_type"))
                                  .alias("destination_type"))
    wanted = t.contract.select("object_id", "name", "source_type").join(found, ["object_id", "name"])
    return contract.destructive_overrides(wanted)
