"""Registered queries: sources, ingestion, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cdc, prepare
from tidemark.operators.governed import LoadPlan, governed_load
from tidemark.operators.prepare import Element, IngestConfig
from tidemark.operators.publish import read_published, write_audit_publish
from tidemark.operators.quality import Rule
from tidemark.plans.inputs import TABLES
from tidemark.plans.registry import Inputs, query
from tidemark.session import scratch_path
from tidemark.sources import pages, tables
from tidemark.sources.tables import ParquetSource
from tidemark.streaming.landing import load_new_files

STAMP = "2024-02-01 00:00:00"


@query("extract_full_orders", "SELECT * FROM {orders}")
def _(t: Inputs) -> DataFrame:
    return tables.extract(t.spark, ParquetSource(t.sf_dir), tables.qualified("orders"))


@query("extract_query_orders", """
    SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled
    FROM {orders} WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'""")
def _(t: Inputs) -> DataFrame:
    sql = """SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled
             FROM {orders} WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP_NTZ '1997-06-01 00:00:00'"""
    return tables.extract(t.spark, ParquetSource(t.sf_dir), query=sql, inputs={"orders": "orders"})


def _since_1998(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return tables.extract_incremental(t.orders, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))


@query("incremental_orders", "SELECT * FROM {orders} WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def _(t: Inputs) -> DataFrame:
    return _since_1998(t)[0]


@query("high_watermark_orders", """
    SELECT max(o_orderdate) AS high_watermark, count(*) AS new_rows
    FROM {orders} WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""")
def _(t: Inputs) -> DataFrame:
    return _since_1998(t)[1]


_MARKS = ("1998-01-01", "1998-05-01")


@query("incremental_landed_mark", f"""
    WITH late AS (SELECT * FROM {{orders}} WHERE o_orderdate > TIMESTAMP '{_MARKS[1]} 00:00:00' AND o_orderstatus = 'P'),
         early AS (SELECT * FROM {{orders}} WHERE NOT (o_orderdate > TIMESTAMP '{_MARKS[1]} 00:00:00' AND o_orderstatus = 'P')),
         first AS (SELECT coalesce(max(o_orderdate), TIMESTAMP '{_MARKS[0]} 00:00:00') AS high_watermark, count(*) AS new_rows
                   FROM early WHERE o_orderdate > TIMESTAMP '{_MARKS[0]} 00:00:00'),
         second AS (SELECT coalesce(max(o_orderdate), any_value(f.high_watermark)) AS high_watermark, count(o_orderkey) AS new_rows
                    FROM first f LEFT JOIN (SELECT * FROM early UNION ALL SELECT * FROM late) ON o_orderdate > f.high_watermark)
    SELECT 1 AS step, * FROM first UNION ALL SELECT 2, * FROM second""")
def _(t: Inputs) -> DataFrame:
    # Two extracts of a growing source; each mark is read from the files that the extract landed.
    root, options = scratch_path(t.spark, "growing"), tables.ExtractOptions("orders", "incremental", "o_orderdate")
    late = (F.col("o_orderdate") > F.lit(_MARKS[1]).cast("timestamp_ntz")) & (F.col("o_orderstatus") == "P")
    mark, marks = F.lit(_MARKS[0]).cast("timestamp_ntz"), None
    for step, arrived in ((1, ~late), (2, late)):
        t.orders.where(arrived).write.mode("append").parquet(f"{root}/orders.parquet")
        landed = scratch_path(t.spark, "landed")
        found = tables.land_configured(t.spark, ParquetSource(root), options, landed, mark)[1]
        mark = F.lit(found.first().high_watermark.isoformat(sep=" ")).cast("timestamp_ntz")
        row = found.select(F.lit(step).alias("step"), "high_watermark", "new_rows")
        marks = row if marks is None else marks.unionByName(row)
    return marks


@query("incremental_orders_late_ties", """
    SELECT * FROM {orders}
    WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'
      AND NOT (o_orderdate = TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus <> 'O')""")
def _(t: Inputs) -> DataFrame:
    mark = F.lit("1998-01-01").cast("timestamp_ntz")
    loaded = t.orders.where((F.col("o_orderdate") <= mark) & (F.col("o_orderstatus") != "O"))
    return tables.extract_incremental(t.orders, "o_orderdate", mark, True, loaded, ["o_orderkey"])[0]


@query("cdc_apply_orders", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS rn
          FROM (SELECT *, 'base' AS op, 0 AS seq FROM {orders} UNION ALL SELECT * FROM {order_changes}))
    WHERE rn = 1 AND op <> 'delete'""")
def _(t: Inputs) -> DataFrame:
    return cdc.apply_cdc(t.orders, t.order_changes, ["o_orderkey"], "seq", "op")


@query("cdc_apply_unfit_changes", """
    SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END AS o_totalprice
    FROM {orders} WHERE o_orderkey % 3 <> 2""")
def _(t: Inputs) -> DataFrame:
    # One change in three has no operation or no number and changes nothing; the others come twice with one number.
    key = F.col("o_orderkey") % 3
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    unfit = orders.where(key == 0).withColumns({
        "op": F.when(F.col("o_orderkey") % 2 == 0, F.lit("delete")), "seq": F.when(F.col("o_orderkey") % 2 == 1, F.lit(1))})
    low = orders.where(key == 1).withColumns({"o_totalprice": F.col("o_totalprice") + 1, "op": F.lit("update"), "seq": F.lit(1)})
    high = low.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    gone = orders.where(key == 2).withColumns({"op": F.lit("delete"), "seq": F.lit(1)})
    changes = unfit.unionByName(low).unionByName(high).unionByName(gone)
    return cdc.apply_cdc(orders, changes, ["o_orderkey"], "seq", "op")


@query("partitioned_orders_by_status", """
    SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM {orders} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "partitioned")
    tables.write_dataset(t.orders, path, partition_by=["o_orderstatus"], compression="zstd")
    back = t.spark.read.parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@query("canonicalize_customer", """
    SELECT c_custkey AS cust_key, c_name AS cust_name, c_nationkey AS nation_key, c_acctbal AS nation_key_2,
           c_mktsegment AS mkt_segment FROM {customer}""")
def _(t: Inputs) -> DataFrame:
    landed = t.customer.toDF(" Cust Key ", "custName", "Nation-Key", "nation key", "MKT_Segment!!")
    return prepare.canonicalize(landed)


_ORDER_TEXT = """
    SELECT CAST(o_orderkey AS STRING) AS o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(length(o_orderpriority) AS STRING)
           END AS o_orderpriority,
           CAST(o_orderdate AS STRING) AS o_orderdate,
           CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN 'true' ELSE 'maybe' END AS o_closed,
           o_totalprice
    FROM {orders}"""



def _plain(df: DataFrame, decimal: str, boolean: str) -> DataFrame:
    """Decimals shown as doubles and nullable booleans as text, which compare alike everywhere."""
    return df.withColumns({decimal: F.col(decimal).cast("double"), boolean: F.col(boolean).cast("string")})


_ORDER_CONTRACT = [
    Element("o_orderkey", "bigint", required=True, nullable=False),
    Element("o_orderpriority", "integer"),
    Element("o_orderdate", "timestamp"),
    Element("o_closed", "boolean"),
    Element("o_totalprice", "decimal(18,2)"),
    Element("o_comment", "string"),
]


@query("cast_contract_orders", f"""
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority,
           TRY_CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
           CAST(TRY_CAST(o_closed AS BOOLEAN) AS VARCHAR) AS o_closed,
           CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_comment,
           TIMESTAMP '{STAMP}' AS _processed_at
    FROM ({_ORDER_TEXT}) s""")
def _(t: Inputs) -> DataFrame:
    clean, _ = prepare.cast_to_contract(t.sql(_ORDER_TEXT), _ORDER_CONTRACT)
    stamped = prepare.with_processing_ts(clean, STAMP)
    return _plain(stamped, "o_totalprice", "o_closed")


@query("cast_failures_orders", """
    SELECT 'o_orderkey' AS "column", CAST(0 AS BIGINT) AS failed_casts
    UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderstatus = 'P') FROM {orders}
    UNION ALL SELECT 'o_orderdate', 0
    UNION ALL SELECT 'o_closed', count(*) FILTER (WHERE o_orderstatus = 'P') FROM {orders}
    UNION ALL SELECT 'o_totalprice', 0
    UNION ALL SELECT 'o_comment', 0""")
def _(t: Inputs) -> DataFrame:
    return prepare.cast_to_contract(t.sql(_ORDER_TEXT), _ORDER_CONTRACT)[1]


_CANONICAL_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'float'
                         WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'json' END"""
_TABLE_LIST = ", ".join(f"'{name}'" for name in TABLES)


@query("schema_manifest_all", f"""
    SELECT table_name AS object, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS "column",
           {_CANONICAL_SQL} AS type
    FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})""")
def _(t: Inputs) -> DataFrame:
    return prepare.schema_manifest({name: getattr(t, name) for name in TABLES}).drop("spark_type")


@query("extract_metrics_all", " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*) AS row_count, true AS has_bytes FROM {{{name}}}" for name in TABLES))
def _(t: Inputs) -> DataFrame:
    parts = None
    for name in TABLES:
        metrics = prepare.extract_metrics(getattr(t, name), f"{t.sf_dir}/{name}.parquet")
        part = metrics.select(F.lit(name).alias("dataset"), "row_count", (F.col("bytes_written") > 0).alias("has_bytes"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("row_counts_all", " UNION ALL ".join(
    f"SELECT '{name}' AS object, count(*) AS row_count, false AS failed FROM {{{name}}}" for name in TABLES)
    + " UNION ALL SELECT 'not_there', NULL, true UNION ALL SELECT 'broken_file', NULL, true")
def _(t: Inputs) -> DataFrame:
    readers = {name: (lambda n=name: getattr(t, n)) for name in TABLES}
    readers["not_there"] = lambda: t.spark.read.parquet(f"{t.sf_dir}/not_there.parquet")
    # Text where a parquet file is expected: found out when the rows are read.
    broken = scratch_path(t.spark, "broken")
    t.orders.select("o_orderpriority").write.text(broken, compression="none")
    readers["broken_file"] = lambda: t.spark.read.schema("a int").parquet(broken)
    counts = prepare.row_counts(t.spark, readers)
    return counts.select("object", "row_count", F.col("error").isNotNull().alias("failed"))


def _api_pages(t: Inputs) -> DataFrame:
    """Customers as page bodies, eight items each, wrapped in turn in each envelope."""
    customer = t.customer
    page = (F.floor(F.col("c_custkey") / 8)).alias("page")
    bodies = customer.groupBy(page).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey")))).alias("items")
    )
    wrapped = F.col("items")
    for i, key in enumerate(pages.ENVELOPE_KEYS):
        # Each wrapper comes after a decoy under the first key that is not a list.
        decoy = "" if key == "data" else '"data": {"note": 1}, '
        wrapped = F.when(F.col("page") % 6 == i, F.concat(F.lit(f'{{{decoy}"{key}": '), "items", F.lit("}"))).otherwise(
            wrapped
        )
    return bodies.select("page", wrapped.alias("body"))


@query("envelope_unwrap", """
    SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS page, CAST(c_custkey % 8 AS INTEGER) AS position, c_custkey, c_name,
           c_nationkey
    FROM {customer}""")
def _(t: Inputs) -> DataFrame:
    items = pages.unwrap_envelope(_api_pages(t), "body")
    return items.select(
        "page", "position",
        F.variant_get("item", "$.c_custkey", "bigint").alias("c_custkey"),
        F.variant_get("item", "$.c_name", "string").alias("c_name"),
        F.variant_get("item", "$.c_nationkey", "int").alias("c_nationkey"),
    )


@query("cursor_path", """
    SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN concat('n', CAST(c_custkey AS VARCHAR)) END AS next_cursor,
           CASE WHEN c_nationkey % 4 = 2 THEN 'top' END AS top_cursor,
           CASE WHEN c_nationkey % 4 = 3 THEN c_custkey END AS page
    FROM {customer}""")
def _(t: Inputs) -> DataFrame:
    kind, key = F.col("c_nationkey") % 4, F.col("c_custkey").cast("string")
    body = (
        F.when(kind == 0, F.concat(F.lit('{"pagination": {"next_cursor": "n'), key, F.lit('"}}')))
        .when(kind == 1, F.lit('{"pagination": "none"}'))
        .when(kind == 2, F.lit('{"data": [], "next_cursor": "top"}'))
        .otherwise(F.concat(F.lit('{"pagination": {"page": '), key, F.lit(', "next_cursor": null}}')))
    )
    landed = t.customer.select("c_custkey", body.alias("body"))
    return landed.select(
        "c_custkey",
        pages.json_path(F.col("body"), "pagination.next_cursor").alias("next_cursor"),
        pages.json_path(F.col("body")).alias("top_cursor"),
        pages.json_path(F.col("body"), "pagination.page", "bigint").alias("page"),
    )


@query("page_slices_customer", """
    SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / 100) AS BIGINT) + 1 AS page
    FROM {customer}""")
def _(t: Inputs) -> DataFrame:
    slim = t.customer.select("c_custkey", "c_acctbal")
    return pages.page_slice(slim, ["c_acctbal", "c_custkey"], 100).select("c_custkey", "page")


@query("page_slices_offset", """
    SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) / 250) AS BIGINT) * 250
           AS "offset" FROM {orders}""")
def _(t: Inputs) -> DataFrame:
    slim = t.orders.select("o_custkey", "o_orderkey")
    return pages.page_slice(slim, ["o_custkey", "o_orderkey"], 250, "offset_limit").select("o_orderkey", "offset")


# Items of indebted customers never arrived, items of rich ones were landed on the next page as well.
_LANDED_ITEMS = """
    SELECT resource, page, item_id FROM {page_items} WHERE c_acctbal >= -900
    UNION ALL SELECT resource, page + 1, item_id FROM {page_items} WHERE c_acctbal > 9900"""


@query("pagination_audit", f"""
    WITH landed AS ({_LANDED_ITEMS}),
         per_page AS (SELECT resource, page, count(*) AS n FROM landed GROUP BY resource, page),
         ends AS (SELECT resource, min(page) FILTER (WHERE n < 8) AS end_page FROM per_page GROUP BY resource),
         base AS (SELECT p.resource, count(*) AS pages, CAST(sum(n) AS BIGINT) AS "rows", any_value(end_page) AS end_page,
                         max(page) - count(*) AS missing_pages,
                         count(*) FILTER (WHERE page > end_page) AS pages_after_end
                  FROM per_page p JOIN ends USING (resource) GROUP BY p.resource),
         copies AS (SELECT resource, count(*) - count(DISTINCT item_id) AS duplicate_items
                    FROM landed GROUP BY resource)
    SELECT resource, pages, "rows", end_page, missing_pages, pages_after_end, duplicate_items,
           end_page IS NOT NULL AND missing_pages = 0 AND pages_after_end = 0 AND duplicate_items = 0 AS clean
    FROM base JOIN copies USING (resource)""")
def _(t: Inputs) -> DataFrame:
    return pages.pagination_audit(t.sql(_LANDED_ITEMS), 8)


# A page is lost when one of its items could not be read.
_LANDED_PAGES = """
    SELECT resource, page, CASE WHEN page > 1 THEN concat('c', CAST(page AS STRING)) END AS cursor,
           CASE WHEN page < 25 THEN concat('c', CAST(page + 1 AS STRING)) END AS next_cursor
    FROM {page_items} GROUP BY resource, page HAVING min(c_acctbal) >= -960"""


@query("cursor_chain", f"""
    WITH landed AS ({_LANDED_PAGES}),
         numbered AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY page) AS rn,
                             lead(page) OVER (PARTITION BY resource ORDER BY page) AS after FROM landed)
    SELECT resource, cursor, CASE WHEN rn = page THEN CAST(page - 1 AS BIGINT) END AS position,
           CASE WHEN rn <> page THEN 'unreachable' WHEN page < 25 AND after IS DISTINCT FROM page + 1 THEN 'dangling'
                ELSE 'ok' END AS status
    FROM numbered""")
def _(t: Inputs) -> DataFrame:
    return pages.cursor_chain(t.sql(_LANDED_PAGES))


#: Fewer than the rows that a task writes, so files are split.
MAX_RECORDS = 1_000


@query("bounded_batch_write", "SELECT count(*) AS n_rows, true AS bounded, 'o_orderkey,o_totalprice' AS \"columns\" FROM {orders}")
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "bounded")
    tables.write_dataset(t.orders, path, max_records=MAX_RECORDS, schema="o_orderkey bigint, o_totalprice decimal(18,2)")
    back = t.spark.read.parquet(path)
    per_file = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= MAX_RECORDS).alias("bounded")).withColumn(
        "columns", F.lit(",".join(back.columns))
    )


@query("format_choice", " UNION ALL ".join(f"""
    SELECT '{fmt}' AS format, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {{orders}}"""
    for fmt in ("parquet", "orc", "json", "csv")))
def _(t: Inputs) -> DataFrame:
    source = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    parts = None
    for fmt in ("parquet", "orc", "json", "csv"):
        path = scratch_path(t.spark, fmt)
        tables.write_dataset(source, path, fmt)
        back = t.spark.read.schema(source.schema).format(fmt).load(path)
        part = back.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"),
                        F.sum("o_totalprice").cast("double").alias("total")).withColumn("format", F.lit(fmt))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("load_append_truncate", """
    SELECT 'appended' AS destination, o_orderstatus, count(*) AS n_rows FROM {orders}
    WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus
    UNION ALL SELECT 'truncated', o_orderstatus, count(*) FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    appended, truncated = scratch_path(t.spark, "load"), scratch_path(t.spark, "load")
    orders = t.orders
    tables.load(orders.where("o_orderstatus = 'F'"), appended, "truncate")
    tables.load(orders.where("o_orderstatus = 'O'"), appended, "append")
    tables.load(orders.where("o_orderstatus = 'F'"), truncated, "truncate")
    tables.load(orders.where("o_orderstatus = 'P'"), truncated, "truncate")
    parts = [t.spark.read.parquet(p).select(F.lit(name).alias("destination"), "o_orderstatus")
             for name, p in (("appended", appended), ("truncated", truncated))]
    return parts[0].unionByName(parts[1]).groupBy("destination", "o_orderstatus").agg(F.count("*").alias("n_rows"))


@query("idempotent_file_load", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM {orders} GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    landing, landed, checkpoint = (scratch_path(t.spark, x) for x in ("landing", "landed", "offsets"))
    orders = t.orders.withColumn("order_year", F.year("o_orderdate"))
    for step in (F.col("order_year") < 1998, F.col("order_year") >= 1998):
        orders.where(step).write.mode("append").parquet(landing)
        # The second call of each step finds nothing new.
        load_new_files(t.spark, landing, orders.schema, landed, checkpoint)
        load_new_files(t.spark, landing, orders.schema, landed, checkpoint)
    return t.spark.read.parquet(landed).groupBy("order_year").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum")
    )


@query("merge_schema_load", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM {orders}""")
def _(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "merged")
    orders = t.orders
    tables.load(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), path)
    tables.load(orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority"), path, merge_schema=True)
    return tables.read_merged(t.spark, path)


_ORDER_RULES = [
    Rule("row_count_min", value=1),
    Rule("not_null", "o_custkey"),
    Rule("unique", "o_orderkey"),
    Rule("accepted_values", "o_orderstatus", accepted=("F", "O", "P")),
]


def _by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count("o_custkey").alias("customers"))


@query("wap_orders_pass", """
    SELECT o_orderstatus, count(*) AS n_rows, count(o_custkey) AS customers, true AS published
    FROM {orders} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    target = scratch_path(t.spark, "published")
    result = write_audit_publish(t.orders, _ORDER_RULES, target, "v1")
    return _by_status(read_published(t.spark, target)).withColumn("published", F.lit(result.published))


@query("wap_orders_block", """
    SELECT o_orderstatus, count(*) AS n_rows, count(o_custkey) AS customers, false AS published,
           (SELECT concat('VIOLATION not_null: column ''o_custkey'' has ', count(*) FILTER (WHERE o_custkey IS NULL),
                          ' null(s); VIOLATION accepted_values: column ''o_orderstatus'' has ',
                          count(*) FILTER (WHERE o_orderstatus = 'X'), ' invalid value(s)')
            FROM {orders_broken}) AS violations
    FROM {orders} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    target = scratch_path(t.spark, "published")
    write_audit_publish(t.orders, _ORDER_RULES, target, "v1")
    result = write_audit_publish(t.orders_broken, _ORDER_RULES, target, "v2")
    return _by_status(read_published(t.spark, target)).select(
        "*", F.lit(result.published).alias("published"), F.lit("; ".join(result.violations)).alias("violations")
    )


@query("export_incremental_orders", """
    SELECT * FROM {orders} WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'""")
def _(t: Inputs) -> DataFrame:
    return cdc.export_select(t.orders, t.orders_exported, ["o_orderkey"])


# Every line keeps its key; some discounts move by a thousandth, some flags turn null or into the text of a null mark, and
# some prices become as large as doubles get or no number at all.
_SMALL_CHANGES = """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_orderkey % 5 = 0 THEN l_discount + 0.001 ELSE l_discount END AS l_discount,
           CASE WHEN l_orderkey % 7 = 0 THEN 1e17 WHEN l_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS l_extendedprice,
           CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE concat(l_returnflag, '|') END AS left_part,
           CASE WHEN l_orderkey % 13 = 1 THEN '|x' ELSE 'x' END AS right_part
    FROM lineitem"""
_SMALL_BASE = """
    SELECT l_orderkey, l_linenumber, l_discount,
           CASE WHEN l_orderkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_extendedprice END AS l_extendedprice,
           CASE WHEN l_orderkey % 13 = 0 THEN '\\N' WHEN l_orderkey % 13 = 1 THEN l_returnflag ELSE concat(l_returnflag, '|') END AS left_part,
           CASE WHEN l_orderkey % 13 = 1 THEN '||x' ELSE 'x' END AS right_part
    FROM lineitem"""


@query("export_incremental_small_changes", f"""
    SELECT l_orderkey, l_linenumber, isnan(l_extendedprice) AS no_number, left_part, right_part
    FROM ({_SMALL_CHANGES.replace(chr(92) * 2, chr(92))})
    WHERE l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 OR l_orderkey % 13 IN (0, 1)""")
def _(t: Inputs) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lineitem")
    source, there = t.spark.sql(_SMALL_CHANGES), t.spark.sql(_SMALL_BASE)
    changed = cdc.export_select(source, there, ["l_orderkey", "l_linenumber"])
    return changed.select("l_orderkey", "l_linenumber", F.isnan("l_extendedprice").alias("no_number"), "left_part", "right_part")


@query("export_full_orders", "SELECT * FROM {orders}")
def _(t: Inputs) -> DataFrame:
    return cdc.export_select(t.orders, t.orders_exported, ["o_orderkey"], "full")


_REVENUE = """
    SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query("transform_revenue_by_segment", _REVENUE)
def _(t: Inputs) -> DataFrame:
    return prepare.transform(t.spark, _REVENUE, {"orders": t.orders, "customer": t.customer})


@query("transform_pass_through", "SELECT * FROM {supplier}")
def _(t: Inputs) -> DataFrame:
    return prepare.transform(t.spark, None, {"supplier": t.supplier}, engine="none")


@query("extract_files", """
    SELECT o_orderstatus, 'orders.parquet' AS file_name, count(*) AS n_rows FROM {orders} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    found = tables.extract_files(t.spark, t.sf_dir, "parquet", "orders*.parquet")
    return found.groupBy("o_orderstatus", F.element_at(F.split("source_file", "/"), -1).alias("file_name")).agg(
        F.count("*").alias("n_rows")
    )


@query("extract_partitioned_files", """
    SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM {orders}""")
def _(t: Inputs) -> DataFrame:
    root = scratch_path(t.spark, "bucket")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("order_year"))
    for year in (True, False):
        some = rows.where((F.col("order_year") < 1995) == year)
        path = f"{root}/{'old' if year else 'new'}"
        tables.land(some, path, tables.ExtractOptions("orders", partition_column="o_orderpriority"))
    found = tables.extract_files(t.spark, root, "parquet", "part-*", partitions="o_orderpriority string")
    return found.select("o_orderkey", "o_orderpriority", "o_orderstatus", "order_year")


@query("extract_bucket_glob", """
    SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM {orders} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    # A bucket with orders in many files, and others that the glob leaves out.
    root = scratch_path(t.spark, "bucket")
    t.orders.repartition(5).write.parquet(f"{root}/raw/orders")
    t.customer.write.json(f"{root}/raw/orders/notes")
    bucket = tables.BucketSource("path", root, "raw", glob="*.parquet")
    sql = "SELECT o_orderstatus, count(*) AS n_rows, sum(o_orderkey) AS key_sum FROM {o} GROUP BY o_orderstatus"
    return tables.extract(t.spark, bucket, query=sql, inputs={"o": "orders"})


def _ingest(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    landed = t.sql(_ORDER_TEXT).toDF(
        "O OrderKey", "O-OrderPriority", "O OrderDate", " o_closed ", "O.TotalPrice"
    )
    contract = [
        Element("o_order_key", "bigint"), Element("o_order_priority", "integer"), Element("o_order_date", "timestamp"),
        Element("o_closed", "boolean"), Element("o_total_price", "decimal(18,2)"),
    ]
    return prepare.run_ingestion(landed, IngestConfig(contract, STAMP, scratch_path(t.spark, "clean")))


@query("ingest_orders_end_to_end", f"""
    SELECT CAST(o_orderkey AS BIGINT) AS o_order_key, TRY_CAST(o_orderpriority AS INTEGER) AS o_order_priority,
           TRY_CAST(o_orderdate AS TIMESTAMP) AS o_order_date,
           CAST(TRY_CAST(o_closed AS BOOLEAN) AS VARCHAR) AS o_closed,
           CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS o_total_price, TIMESTAMP '{STAMP}' AS _processed_at
    FROM ({_ORDER_TEXT}) s""")
def _(t: Inputs) -> DataFrame:
    return _plain(_ingest(t)[0], "o_total_price", "o_closed")


@query("ingest_orders_metrics", """
    WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial,
                      count(*) FILTER (WHERE o_orderstatus <> 'F') AS not_closed FROM {orders})
    SELECT 'row_count' AS metric, n AS value FROM s
    UNION ALL SELECT 'null_count_o_order_key', 0 UNION ALL SELECT 'failed_casts_o_order_key', 0
    UNION ALL SELECT 'null_count_o_order_priority', partial FROM s
    UNION ALL SELECT 'failed_casts_o_order_priority', partial FROM s
    UNION ALL SELECT 'null_count_o_order_date', 0 UNION ALL SELECT 'failed_casts_o_order_date', 0
    UNION ALL SELECT 'null_count_o_closed', not_closed FROM s
    UNION ALL SELECT 'failed_casts_o_closed', partial FROM s
    UNION ALL SELECT 'null_count_o_total_price', 0 UNION ALL SELECT 'failed_casts_o_total_price', 0""")
def _(t: Inputs) -> DataFrame:
    return _ingest(t)[1]


@query("governed_load_orders", """
    SELECT 'v1' AS run_id, 'success' AS status, CAST(NULL AS VARCHAR) AS failed_task, count(*) AS rows_extracted,
           count(*) AS rows_published, CAST(0 AS INTEGER) AS n_violations, '' AS violations, CAST(6 AS BIGINT) AS lineage_edges
    FROM {orders}
    UNION ALL
    SELECT 'v2', 'quality_failed', 'validation_and_metrics.quality_gate', count(*), 0,
           CAST(2 AS INTEGER), concat('VIOLATION not_null: column ''o_custkey'' has ', count(*) FILTER (WHERE o_custkey IS NULL),
               ' null(s); VIOLATION accepted_values: column ''o_orderstatus'' has ',
               count(*) FILTER (WHERE o_orderstatus = 'X'), ' invalid value(s)'), 6
    FROM {orders_broken}""")
def _(t: Inputs) -> DataFrame:
    elements = [
        Element("o_orderkey", "bigint", True, False), Element("o_custkey", "bigint"), Element("o_orderstatus", "string"),
        Element("o_totalprice", "decimal"), Element("o_orderdate", "date"), Element("o_orderpriority", "string"),
    ]
    plan = LoadPlan("source.orders", "lake.orders", elements, _ORDER_RULES, scratch_path(t.spark, "governed"), STAMP)
    records = []
    for version, source in (("v1", t.orders), ("v2", t.orders_broken)):
        outcome = governed_load(source, plan, version)
        records.append(outcome.run.withColumn("lineage_edges", F.lit(outcome.lineage.count())))
    return records[0].unionByName(records[1])
