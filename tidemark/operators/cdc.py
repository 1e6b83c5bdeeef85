"""Applying change rows to a base table, and selecting changes for export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksum import exact_hash
from tidemark.session import cut


def apply_cdc(base: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str) -> DataFrame:
    """Base after the changes: the last change per key wins and ``delete`` removes the row. Keys are never null.

    Changes without an operation or a sequence number are not applied; ``rejected_changes`` returns them. Of changes with
    equal sequence numbers the greatest by (operation, values) wins, whatever their order. The last change is an aggregate
    that merges map-side, so a key changed very often stays cheap.
    """
    changes = changes.where(F.col(op).isNotNull() & F.col(seq).isNotNull())
    values = [c for c in base.columns if c not in keys]
    # Aggregated once and written, so that its true size decides how the base is joined.
    last = cut(changes.groupBy(*keys).agg(F.max(F.struct(seq, op, *values)).alias("c")), "changes")
    kept = base.join(last.select(*keys), keys, "left_anti")
    written = last.where(F.col(f"c.{op}") != "delete").select(*keys, *[F.col(f"c.{v}").alias(v) for v in values])
    return kept.select(*base.columns).unionByName(written.select(*base.columns))


def rejected_changes(changes: DataFrame, seq: str, op: str) -> DataFrame:
    """Changes that cannot be applied, with the reason."""
    reason = F.when(F.col(op).isNull(), "no operation").when(F.col(seq).isNull(), "no sequence number")
    return changes.withColumn("reason", reason).where("reason IS NOT NULL")


def _match(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join where nulls equal each other."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same, how)


def export_select(
    source: DataFrame, destination: DataFrame | None, keys: list[str], mode: str = "incremental"
) -> DataFrame:
    """All rows, or those whose key is new or whose content differs at the destination."""
    if mode == "full" or destination is None:
        return source
    hashed = source.withColumn("_hash", exact_hash(source, source.columns))
    seen = destination.select(*keys, exact_hash(destination.select(*[F.col(c).cast(source.schema[c].dataType).alias(c) for c in source.columns]), source.columns).alias("_hash"))
    on = [*keys, "_hash"]
    # Only keys and hashes are shuffled to find what changed; whole rows are then picked by that list,
    # which is broadcast when the written list turns out small.
    changed = cut(_match(hashed.select(*on), seen, on, "left_anti"), "export")
    return _match(hashed, changed, on, "left_semi").drop("_hash")
