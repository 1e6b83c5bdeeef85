"""Landed API pages: unwrapping, cursors, page slicing and auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Ordered
from tidemark.session import cut, cut_counted

# Envelope keys in the order they are tried.
ENVELOPE_KEYS = ("data", "items", "results", "records", "content")


def envelope_items(body: Column) -> Column:
    """Items of one page body (a VARIANT): a top-level array, else the first wrapper key holding a list."""
    paths = ["$", *[f"$.{key}" for key in ENVELOPE_KEYS]]
    return F.coalesce(*[F.try_variant_get(body, path, "array<variant>") for path in paths])


def unwrap_envelope(pages: DataFrame, body_col: str) -> DataFrame:
    """One row per item: the page's other columns, ``position`` in the page (from 0) and ``item``."""
    others = [c for c in pages.columns if c != body_col]
    parsed = pages.select(*others, F.try_parse_json(F.col(body_col)).alias("_body"))
    return parsed.select(*others, F.posexplode(envelope_items(F.col("_body"))).alias("position", "item"))


def json_path(body: Column, path: str = "next_cursor", kind: str = "string") -> Column:
    """Value at a dotted path of a JSON text; null when a step is missing or not an object."""
    # Keys are quoted so that a digit or a dash in one is never read as an index or an operator.
    steps = "".join(f"['{key}']" for key in path.split("."))
    return F.try_variant_get(F.try_parse_json(body), f"${steps}", kind)


def page_slice(
    df: DataFrame, order: list[str], size: int = 100, strategy: str = "page_number", page_start: int = 1
) -> DataFrame:
    """Add ``page`` (or ``offset``) by position in a total order; ``none`` is a single page."""
    if strategy == "none":
        return df.withColumn("page", F.lit(page_start).cast("bigint"))
    numbered = Ordered(df, order).row_number("_rn").done()
    index = F.floor((F.col("_rn") - 1) / size)
    if strategy == "page_number":
        return numbered.withColumn("page", index + page_start).drop("_rn")
    if strategy == "offset_limit":
        return numbered.withColumn("offset", index * size).drop("_rn")
    raise ValueError(f"unknown page strategy {strategy!r}")


def pagination_audit(items: DataFrame, size: int, page_start: int = 1) -> DataFrame:
    """Per resource: where the run ended, gaps, pages after the end, duplicate items and totals.

    ``items`` has ``resource``, ``page`` and ``item_id`` (null on the single row of an empty page).
    """
    pages = items.groupBy("resource", "page").agg(F.count("item_id").alias("n"))
    ends = pages.groupBy("resource").agg(
        F.min(F.when(F.col("n") < size, F.col("page"))).alias("end_page"),
        F.count("*").alias("pages"),
        F.sum("n").alias("rows"),
        (F.max("page") - page_start + 1 - F.count("*")).alias("missing_pages"),
    )
    late = (
        pages.join(ends.select("resource", "end_page"), "resource")
        .where("page > end_page")
        .groupBy("resource")
        .agg(F.count("*").alias("pages_after_end"))
    )
    copies = (
        items.where("item_id IS NOT NULL")
        .groupBy("resource", "item_id")
        .agg((F.count("*") - 1).alias("extra"))
        .groupBy("resource")
        .agg(F.sum("extra").alias("duplicate_items"))
    )
    return (
        ends.join(late, "resource", "left")
        .join(copies, "resource", "left")
        .select(
            "resource", "pages", "rows", "end_page", "missing_pages",
            F.coalesce("pages_after_end", F.lit(0)).alias("pages_after_end"),
            F.coalesce("duplicate_items", F.lit(0)).alias("duplicate_items"),
            (
                F.col("end_page").isNotNull()
                & (F.col("missing_pages") == 0)
                & (F.coalesce("pages_after_end", F.lit(0)) == 0)
                & (F.coalesce("duplicate_items", F.lit(0)) == 0)
            ).alias("clean"),
        )
    )


def cursor_chain(pages: DataFrame) -> DataFrame:
    """Order pages by following cursors from each resource's first page (null ``cursor``).

    Input: ``resource``, ``cursor`` (that fetched the page), ``next_cursor``. Output adds ``position``
    from 0, null for pages no chain reaches, and ``status``: ok, dangling (its next page was never
    landed) or unreachable. Jumps double each round, so a chain of n pages takes log2(n) joins; copies
    of a page collapse first and a cycle stops at the page count.
    """
    page_id = F.coalesce(F.col("cursor"), F.lit(""))
    landed, total = cut_counted(
        pages.groupBy("resource", page_id.alias("id"))
        .agg(F.min(F.when(F.col("next_cursor") != "", F.col("next_cursor"))).alias("next")),
        "chain",
    )
    known = landed.select("resource", F.col("id").alias("next"))
    jumps, left = cut_counted(
        landed.where("next IS NOT NULL").join(known, ["resource", "next"]).select("resource", "id", "next"), "jumps"
    )
    reached = landed.where("id = ''").select("resource", "id", F.lit(0).cast("bigint").alias("position"))
    step = 1
    while step <= total and left:
        ahead = reached.join(jumps, ["resource", "id"]).select(
            "resource", F.col("next").alias("id"), (F.col("position") + step).alias("position")
        )
        reached = cut(
            reached.unionByName(ahead).groupBy("resource", "id").agg(F.min("position").alias("position")), "reached"
        )
        onward = jumps.select("resource", F.col("id").alias("next"), F.col("next").alias("_far"))
        jumps, left = cut_counted(
            jumps.join(onward, ["resource", "next"]).select("resource", "id", F.col("_far").alias("next")), "jumps"
        )
        step *= 2
    dangling = landed.where("next IS NOT NULL").join(known, ["resource", "next"], "left_anti").select("resource", "id")
    return (
        landed.join(reached, ["resource", "id"], "left")
        .join(dangling.withColumn("_dangling", F.lit(True)), ["resource", "id"], "left")
        .select(
            "resource",
            F.when(F.col("id") != "", F.col("id")).alias("cursor"),
            "position",
            F.when(F.col("position").isNull(), "unreachable")
            .when(F.col("_dangling"), "dangling")
            .otherwise("ok")
            .alias("status"),
        )
    )
