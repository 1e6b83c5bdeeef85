"""Schema drift between two sets of snapshots: events, severity, gate and planned actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types a type may widen into.
WIDENS_TO = {
    "integer": ("bigint", "float", "decimal"),
    "bigint": ("float", "decimal"),
    "float": ("decimal",),
}

# Change types that need a human decision; all others are informative.
CRITICAL = ("field_removed", "type_incompatible", "nullable_to_required", "object_removed")

# Change types that stop a run.
BLOCKING = ("field_removed", "type_incompatible")

EVENT_COLUMNS = [
    "object_id", "field_name", "change_type", "description", "previous_value", "current_value", "event_order",
]


def is_compatible(previous: Column, current: Column) -> Column:
    """Same type but for case, or a widening."""
    before, after = F.lower(previous), F.lower(current)
    widened = before == after
    for narrow, wider in WIDENS_TO.items():
        widened = widened | ((before == narrow) & after.isin(*wider))
    return widened


def presence(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row per object: whether it was there before (``had``) and is there now (``has``)."""
    sides = previous.select("object_id", F.lit(True).alias("had"), F.lit(False).alias("has")).unionByName(
        current.select("object_id", F.lit(False).alias("had"), F.lit(True).alias("has"))
    )
    return sides.groupBy("object_id").agg(F.bool_or("had").alias("had"), F.bool_or("has").alias("has"))


def object_events(previous: DataFrame, current: DataFrame, removed: bool = False) -> DataFrame:
    """Added objects, and removed ones when asked for."""
    known = presence(previous, current)
    events = _object_event(known.where("NOT had"), "object_added", "added to")
    if removed:
        events = events.unionByName(_object_event(known.where("NOT has"), "object_removed", "removed from"))
    return events


def _object_event(objects: DataFrame, change: str, verb: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return objects.select(
        "object_id", none.alias("field_name"), F.lit(change).alias("change_type"),
        F.concat(F.lit("Object "), "object_id", F.lit(f" {verb} source.")).alias("description"),
        none.alias("previous_value"), none.alias("current_value"), F.lit(-1).cast("bigint").alias("event_order"),
    )


def _pairs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Fields of both sides paired by (object, field), with the presence of their object, from one exchange by object.

    What an object has on either side is a window over its pairs, which lie together already.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        own = {"type": "normalized_type", "nullable": "nullable", "ordinal": "ordinal"}
        columns = [F.col(own[c]).alias(f"{m}_{c}") if m == mark else F.lit(None).alias(f"{m}_{c}") for m in "pc" for c in own]
        return df.select("object_id", "name", *columns)

    both = side(previous, "p").unionByName(side(current, "c")).repartition("object_id")
    kinds = {"type": "string", "nullable": "boolean", "ordinal": "bigint"}
    pairs = both.groupBy("object_id", "name").agg(
        *[F.max(f"{m}_{c}").cast(kind).alias(f"{m}_{c}") for m in "pc" for c, kind in kinds.items()])
    whole = Window.partitionBy("object_id")
    return pairs.withColumns({
        "had": F.bool_or(F.col("p_ordinal").isNotNull()).over(whole), "has": F.bool_or(F.col("c_ordinal").isNotNull()).over(whole),
        "nth": F.row_number().over(whole.orderBy("name"))})


def field_events(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Field events of objects present on both sides, keyed by field name whatever its position.

    ``event_order`` sorts an object's events: current fields by ordinal, type before nullability, then
    removed fields.
    """
    return pair_events(_pairs(previous, current).where("had AND has"), ["object_id"])


def _event(when: Column, change: Column | str, text: Column, before: Column, after: Column, rank: Column, field: Column) -> Column:
    """An event as a struct, null where it did not happen."""
    kind = F.lit(change) if isinstance(change, str) else change
    return F.when(
        when,
        F.struct(field.alias("field_name"), kind.alias("change_type"), text.alias("description"), before.alias("previous_value"),
                 after.alias("current_value"), rank.alias("event_order")),
    )


def pair_events(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Events of paired fields: name and, for the side before (p) and now (c), type, nullable and ordinal."""
    return _exploded(pairs, keys, _field_candidates())


def _exploded(pairs: DataFrame, keys: list[str], candidates: list[Column]) -> DataFrame:
    events = pairs.select(*keys, F.explode(F.array_compact(F.array(*candidates))).alias("e"))
    return events.select(*keys, *[F.col(f"e.{c}") for c in EVENT_COLUMNS if c != "object_id"])


def _field_candidates() -> list[Column]:
    old, new = F.col("p_type"), F.col("c_type")
    was, now = F.col("p_nullable"), F.col("c_nullable")
    shared = F.col("p_ordinal").isNotNull() & F.col("c_ordinal").isNotNull()
    none = F.lit(None).cast("string")
    field = F.col("name")

    def event(when: Column, change: Column | str, text: Column, before: Column, after: Column, rank: Column) -> Column:
        return _event(when, change, text, before, after, rank, field)

    compatible = is_compatible(old, new)
    position = F.col("c_ordinal") * 2
    last = F.lit(1 << 62).cast("bigint")
    return [
        event(F.col("p_ordinal").isNull(), "field_added", F.concat(F.lit("Field "), field, F.lit(" added.")), none, new,
              position),
        event(shared & (old != new), F.when(compatible, "type_widened").otherwise("type_incompatible"),
              F.concat(F.when(compatible, "Type widened from ").otherwise("Incompatible type change from "), old,
                       F.lit(" to "), new, F.lit(".")), old, new, position),
        event(shared & was & ~now, "nullable_to_required",
              F.concat(F.lit("Field "), field, F.lit(" changed from nullable to required.")), none, none, position + 1),
        event(shared & ~was & now, "required_to_nullable",
              F.concat(F.lit("Field "), field, F.lit(" changed from required to nullable.")), none, none, position + 1),
        event(F.col("c_ordinal").isNull(), "field_removed", F.concat(F.lit("Field "), field, F.lit(" removed.")), old,
              none, last + F.col("p_ordinal")),
    ]


def diff(previous: DataFrame, current: DataFrame, removed: bool = False) -> DataFrame:
    """All drift events from previous to current snapshots, from one exchange of fields."""
    none, first = F.lit(None).cast("string"), F.col("nth") == 1

    def whole(when: Column, change: str, verb: str) -> Column:
        text = F.concat(F.lit("Object "), "object_id", F.lit(f" {verb} source."))
        return _event(when & first, change, text, none, none, F.lit(-1).cast("bigint"), none)

    both = F.col("had") & F.col("has")
    candidates = [F.when(both, event) for event in _field_candidates()]
    candidates.append(whole(~F.col("had"), "object_added", "added to"))
    if removed:
        candidates.append(whole(~F.col("has"), "object_removed", "removed from"))
    return _exploded(_pairs(previous, current), ["object_id"], candidates)


def with_severity(events: DataFrame) -> DataFrame:
    critical = F.col("change_type").isin(*CRITICAL)
    return events.withColumn("severity", F.when(critical, "critical").otherwise("informative")).withColumn(
        "requires_approval", critical
    )


def drift_summary(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by severity per object (or per run)."""
    critical = F.col("change_type").isin(*CRITICAL)
    return events.groupBy(*(by or ["object_id"])).agg(
        F.count_if(critical).alias("critical_events"),
        F.count_if(~critical).alias("informative_events"),
        (F.count_if(critical) > 0).alias("has_critical"),
    )


def drift_gate(
    previous: DataFrame, current: DataFrame, events: DataFrame, blocking: tuple[str, ...] = BLOCKING
) -> DataFrame:
    """Whether each object may proceed, and why not.

    An object missing on either side proceeds. The reason lists an object's fields, so it is as long as
    its schema is wide.
    """
    objects = presence(previous, current).select("object_id")
    stops = events.where(F.col("change_type").isin(*blocking) & F.col("field_name").isNotNull())
    item = F.struct("event_order", F.concat("field_name", F.lit(": "), "change_type").alias("text"))
    reasons = stops.groupBy("object_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["text"]), "; ").alias("_why")
    )
    return objects.join(reasons, "object_id", "left").select(
        "object_id", F.col("_why").isNull().alias("can_proceed"),
        F.coalesce(F.concat(F.lit("Incompatible drift detected: "), "_why"), F.lit("")).alias("blocked_reason"),
    )


def plan_actions(events: DataFrame, policy: str | Column) -> DataFrame:
    """What to do per object: critical drift always blocks, otherwise the policy decides.

    Policies: block, self_heal, alert_only.
    """
    chosen = F.lit(policy) if isinstance(policy, str) else policy
    ranked = events.select(
        "object_id", chosen.alias("_policy"), F.col("change_type").isin(*CRITICAL).alias("_critical")
    )
    per_object = ranked.groupBy("object_id").agg(
        F.bool_or("_critical").alias("has_critical"), F.min("_policy").alias("policy")
    )
    return per_object.select(
        "object_id", "policy", "has_critical",
        F.when(F.col("has_critical") | (F.col("policy") == "block"), "block")
        .when(F.col("policy") == "self_heal", "self_heal")
        .otherwise("alert")
        .alias("action"),
    )
