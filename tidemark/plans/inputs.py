"""Inputs that the test tables do not hold as such, derived from whole tables.

Each derived input is one SQL text both engines run, so that the operators under test start from the same
rows. ``{name}`` refers to a table or another derived input; the few words that differ between the two
dialects are marked ``@`` and listed in ``DIALECT``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# marker: (Spark, oracle)
DIALECT = {
    "@list": ("array", "list_value"),
    "@k": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "@at": ("element_at", "list_extract"),
    "@each": ("explode", "unnest"),
}

DERIVED = {
    # Run history: one run per event.
    "runs": """
        SELECT event_id AS run_id, user_id AS pipeline_id, pipeline_type, started_at, status,
               CASE WHEN status = 'running' THEN NULL ELSE started_at + INTERVAL '1' MINUTE * k END AS finished_at,
               CASE status WHEN 'quality_failed' THEN 'quality_gate'
                           WHEN 'failed' THEN @at(@list('extract', 'transform', 'load'), CAST(k % 3 + 1 AS INT))
               END AS failed_task,
               90 AS sla_minutes, k,
               CASE WHEN status = 'quality_failed'
                    THEN CASE event_id % 3 WHEN 0 THEN @list('v1') WHEN 1 THEN @list('v1', 'v2')
                                           ELSE @list('v1', 'v2', 'v3') END
                    ELSE CAST(@list() AS @strings) END AS quality_violations,
               CASE WHEN status = 'partial'
                    THEN @list(CASE WHEN k < 40 THEN 'emit_raw_lineage' ELSE 'success_notification' END)
                    ELSE CAST(@list() AS @strings) END AS optional_failures
        FROM (SELECT event_id, user_id, ts AS started_at, @k AS k,
                     CASE user_id % 3 WHEN 0 THEN 'ingestion' WHEN 1 THEN 'etl' ELSE 'export' END AS pipeline_type,
                     CASE WHEN event_id % 50 = 0 THEN 'running'
                          WHEN event_type IN ('purchase', 'view') THEN 'success'
                          WHEN event_type = 'signup' THEN 'partial'
                          WHEN event_type = 'click' THEN 'quality_failed'
                          ELSE 'failed' END AS status
              FROM {events}) e""",
    # Four tasks of every run, with states that lead to its status.
    "run_tasks": """
        SELECT run_id, n AS task_order,
               @at(@list('compute.extract', 'validation_and_metrics.quality_gate', 'warehouse.load',
                         'observability.emit_raw_lineage'), n) AS task_id,
               n = 4 AS optional,
               CASE WHEN bad = 0 OR n < bad THEN 'success' WHEN n = bad THEN 'failed'
                    ELSE 'upstream_failed' END AS state
        FROM (SELECT run_id, @each(@list(1, 2, 3, 4)) AS n,
                     CASE WHEN status = 'quality_failed' THEN 2
                          WHEN status = 'failed' AND k % 2 = 0 THEN 1
                          WHEN status = 'failed' THEN 3
                          WHEN status = 'partial' THEN 4 ELSE 0 END AS bad
              FROM {runs}) r""",
    # Each pipeline waits for the one before it.
    "deps": """
        SELECT DISTINCT user_id AS pipeline_id, user_id - 1 AS depends_on, user_id % 2 = 0 AS require_same_day
        FROM {events}""",
    # Lifecycle states per asset, mostly out of order.
    "state_log": """
        SELECT user_id AS asset_id, ts AS happened_at, event_id,
               CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'active' WHEN 'click' THEN 'active'
                               WHEN 'purchase' THEN 'deprecated' ELSE 'archived' END AS state
        FROM {events}""",
    "audit": """
        SELECT user_id AS entity_id, ts AS happened_at, event_id AS audit_id, event_type,
               concat('actor_', CAST(@k % 7 AS STRING)) AS actor_id
        FROM {events}""",
    # Orders with missing customers, odd statuses and unknown customers.
    "orders_broken": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN o_custkey + 10000000
                    ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 23 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        FROM {orders}""",
    # Customers that are in debt have left the parent table.
    "customer_kept": "SELECT * FROM {customer} WHERE c_acctbal >= 0",
    # Change feed: high priorities were repriced twice, low ones deleted, unspecified ones copied as new.
    "order_changes": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 5 AS o_totalprice, o_orderdate,
               o_orderpriority, 'update' AS op, 1 AS seq
        FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'delete' ELSE 'update' END, 2
        FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
        UNION ALL
        SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               'insert', 1
        FROM {orders} WHERE o_orderpriority = '4-NOT SPECIFIED'""",
    # What an export destination holds: nothing of the open orders, an old price for some others.
    "orders_exported": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderstatus <> 'O'""",
    # Two schema captures of many objects, the later one early in the month for some and late for others.
    "field_sightings": """
        SELECT concat('obj_', CAST(user_id AS STRING), '_', event_type) AS object_id,
               concat('f', CAST(CAST(floor(k / 20) AS BIGINT) AS STRING)) AS name,
               event_id, k,
               ts >= CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-06 00:00:00'
                          ELSE TIMESTAMP '2024-01-26 00:00:00' END AS recent
        FROM (SELECT event_id, user_id, event_type, ts, @k AS k FROM {events}) e""",
    "capture": """
        SELECT object_id, recent, name, min(event_id) AS ordinal,
               @at(@list('integer', 'bigint', 'float', 'decimal', 'string', 'Integer', 'uuid'),
                   CAST(max(k) % 7 + 1 AS INT)) AS normalized_type,
               min(k) % 2 = 0 AS nullable, name = 'f0' AS is_primary_key,
               CASE WHEN max(k) % 5 = 0 THEN NULL ELSE concat('about ', name) END AS description
        FROM {field_sightings} GROUP BY object_id, recent, name""",
    "fields_before": """
        SELECT object_id, ordinal, name, normalized_type AS source_type, normalized_type, nullable,
               is_primary_key, description
        FROM {capture} WHERE NOT recent""",
    "fields_after": """
        SELECT object_id, ordinal, name, normalized_type AS source_type, normalized_type, nullable,
               is_primary_key, description
        FROM {capture} WHERE recent""",
    # A destination contract made from the earlier capture.
    "contract": """
        SELECT object_id, name,
               CASE WHEN normalized_type IN ('Integer', 'uuid') THEN 'string' ELSE normalized_type END AS source_type,
               CASE WHEN normalized_type IN ('Integer', 'uuid') THEN 'string' ELSE normalized_type
               END AS destination_type,
               NOT nullable AS required, nullable, is_primary_key, description
        FROM {fields_before}""",
    # Every event captures its user's three-column schema; two traits of the event shape it.
    "schema_captures": """
        SELECT concat('obj_', CAST(user_id AS STRING)) AS object_id, ts AS captured_at, event_id AS snapshot_id,
               @k >= 80 AS wide, event_type = 'error' AS loose, event_type = 'view' AS swapped
        FROM {events}""",
    # Discovery runs of an asset.
    "discovery_runs": """
        SELECT run_id, pipeline_id AS asset_id, started_at AS created_at, started_at,
               CASE WHEN status IN ('success', 'quality_failed') THEN 'completed'
                    WHEN status IN ('partial', 'running') THEN status ELSE 'failed' END AS status,
               finished_at AS completed_at
        FROM {runs}""",
    # Lineage between the key columns of the tables.
    "lineage_edges": """
        SELECT 'region' AS src_object, concat('r', CAST(n_regionkey AS STRING)) AS src_column,
               'nation' AS dst_object, concat('n', CAST(n_nationkey AS STRING)) AS dst_column,
               CAST(NULL AS STRING) AS expression
        FROM {nation}
        UNION ALL
        SELECT 'nation', concat('n', CAST(c_nationkey AS STRING)), 'customer',
               concat('c', CAST(c_custkey AS STRING)), CAST(NULL AS STRING)
        FROM {customer}
        UNION ALL
        SELECT 'customer', concat('c', CAST(o_custkey AS STRING)), 'orders',
               concat('o', CAST(o_orderkey AS STRING)), CASE WHEN o_orderstatus = 'F' THEN 'SHA256(key)' END
        FROM {orders}
        UNION ALL
        SELECT 'orders', concat('o', CAST(l_orderkey AS STRING)), 'part',
               concat('p', CAST(l_partkey AS STRING)), CASE WHEN l_returnflag = 'R' THEN 'SUM(quantity)' END
        FROM {lineitem}""",
    # API pages of customers: eight items a page, 25 pages a resource, wrapped in turn six ways.
    "page_items": """
        SELECT CAST(floor(c_custkey / 200) AS BIGINT) AS resource,
               CAST(floor((c_custkey % 200) / 8) AS BIGINT) + 1 AS page, c_custkey AS item_id, c_acctbal
        FROM {customer}""",
}

DIALECT["@strings"] = ("array<string>", "VARCHAR[]")


def _speak(text: str, engine: int) -> str:
    # Longest marker first, so that @at never eats the head of another one.
    for marker in sorted(DIALECT, key=len, reverse=True):
        text = re.sub(re.escape(marker) + r"(?![a-z])", lambda _, m=marker: DIALECT[m][engine], text)
    return text


def _references(text: str) -> list[str]:
    return [name for name in dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """Tables and derived inputs of one scale folder by attribute: ``t.orders``, ``t.runs``.

    Each is defined once per query, so a table's footer is read once however often it is used.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES and name not in DERIVED:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = table(self.spark, self.sf_dir, name) if name in TABLES else self.sql(DERIVED[name])
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Rows of a text with ``{name}`` references and dialect markers."""
        return self.spark.sql(_speak(text, 0), **{ref: getattr(self, ref) for ref in _references(text)})


def oracle_text(text: str) -> str:
    """Oracle SQL for a text with ``{name}`` references: derived inputs become common table expressions."""
    ctes: dict[str, str] = {}

    def visit(body: str) -> str:
        for ref in _references(body):
            if ref in DERIVED and ref not in ctes:
                definition = visit(DERIVED[ref])
                ctes[ref] = definition
        return re.sub(r"\{([a-z_]+)\}", r"\1", _speak(body, 1))

    body = visit(text)
    if not ctes:
        return body
    prefix = ", ".join(f"{name} AS ({definition})" for name, definition in ctes.items())
    recursive = re.match(r"\s*WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"\s*WITH\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {prefix}, {body[recursive.end():]}"
    if plain:
        return f"WITH {prefix}, {body[plain.end():]}"
    return f"WITH {prefix} {body}"
