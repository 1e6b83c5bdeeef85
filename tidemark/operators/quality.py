"""Quality metrics in one pass, gate evaluation with exact messages, verdicts and contract checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.checksum import checksum
from tidemark.operators.prepare import Element, long_counts, null_count

RULE_FIELDS = {"rule_id": "int", "type": "string", "column": "string", "value": "double", "text": "string"}

# Which metric each rule type reads.
RULE_METRICS = {
    "row_count_min": "row_count",
    "not_null": "null_count",
    "unique": "duplicate_count",
    "accepted_values": "invalid_value_count",
    "referential_integrity": "orphan_count",
    "checksum": "checksum",
    "null_pct_max": "null_pct",
}

# Exact distinct counts computed together; each multiplies the rows before their partial aggregation.
DISTINCTS_PER_PASS = 4


@dataclass(frozen=True)
class Rule:
    """A quality rule. ``column`` may name several columns joined by commas (composite unique keys)."""

    type: str
    column: str | None = None
    value: float | None = None
    text: str | None = None
    accepted: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in (self.column or "").split(",") if c.strip()]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (i, r.type, r.column, None if r.value is None else float(r.value), r.text) for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{name} {kind}" for name, kind in RULE_FIELDS.items()))


def duplicate_count(columns: list[str], approx: float | None = None) -> Column:
    """Non-null rows minus distinct non-null keys; ``approx`` is a relative error for a sketch instead."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    rows = F.count_if(present)
    if approx is None:
        return rows - F.count_distinct(*[F.col(c) for c in columns])
    key = F.when(present, F.xxhash64(*columns))
    return F.greatest(rows - F.approx_count_distinct(key, approx), F.lit(0))


def invalid_value_count(column: str, accepted: tuple[str, ...]) -> Column:
    return F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*accepted))


def invalid_values(df: DataFrame, column: str, accepted: DataFrame) -> DataFrame:
    """Rows per value outside an accepted list too long to inline. Values are counted before the join."""
    present = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return present.join(accepted.toDF(column), column, "left_anti")


def orphans(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, by: list[str] | None = None
) -> DataFrame:
    """Child rows per non-null key that no parent has.

    Child rows are counted per key before the join, so a key that holds a third of the rows crosses the
    shuffle as a handful of partial counts.
    """
    keys = [*(by or []), child_key]
    counted = child.where(F.col(child_key).isNotNull()).groupBy(*keys).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias("_parent"))
    return counted.join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The offending child rows themselves."""
    known = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def orphan_metric(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, by: list[str] | None = None
) -> DataFrame:
    """The orphan count as a metric row, per batch when ``by`` is given; batches without orphans count zero.

    Keys are counted first here too. A parent key found twice does no harm: only unmatched keys add up.
    """
    by = list(by or [])
    counted = child.groupBy(*by, child_key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias("_parent"))
    joined = counted.join(known, F.col(child_key) == F.col("_parent"), "left")
    lost = F.when(F.col(child_key).isNotNull() & F.col("_parent").isNull(), F.col("rows"))
    total = F.coalesce(F.sum(lost), F.lit(0)).cast("double").alias("value")
    return joined.groupBy(*by).agg(total).select(
        *by, F.lit("orphan_count").alias("metric"), F.lit(child_key).alias("column"), "value",
        F.lit(None).cast("string").alias("text"),
    )


def profile(
    df: DataFrame, rules: list[Rule], by: list[str] | None = None, approx: float | None = None
) -> DataFrame:
    """All metrics the rules need as (metric, column, value, text), in one aggregate over one scan.

    ``by`` profiles each batch or partition value apart. Exact distinct counts share one Expand whose
    partial aggregation removes repeats before the shuffle; since it multiplies rows, every further
    ``DISTINCTS_PER_PASS`` of them take a pass of their own over just their columns, unless ``approx``
    allows a sketch. Orphan counts need a second table and come from ``orphan_metric``.
    """
    by = list(by or [])
    wanted: dict[tuple[str, str | None], Column] = {("row_count", None): F.count("*")}
    distincts: dict[tuple[str, str | None], Column] = {}
    for rule in rules:
        metric = RULE_METRICS.get(rule.type)
        if metric == "null_count":
            wanted[metric, rule.column] = null_count(rule.column)
        elif metric == "null_pct":
            share = null_count(rule.column) * 100.0 / F.count("*")
            wanted[metric, rule.column] = F.when(F.count("*") > 0, share)
        elif metric == "duplicate_count":
            target = wanted if approx is not None else distincts
            target[metric, rule.column] = duplicate_count(rule.columns, approx)
        elif metric == "invalid_value_count":
            wanted[metric, rule.column] = invalid_value_count(rule.column, rule.accepted)
        elif metric == "checksum":
            wanted[metric, None] = checksum(df, [c for c in df.columns if c not in by])
    keyed = list(distincts)
    passes = [keyed[i : i + DISTINCTS_PER_PASS] for i in range(0, len(keyed), DISTINCTS_PER_PASS)] or [[]]
    groups = [{key: distincts[key] for key in one} for one in passes]
    groups[0] = {**wanted, **groups[0]}
    return reduce(lambda a, b: a.unionByName(b), [_long_metrics(df, group, by) for group in groups])


def _long_metrics(df: DataFrame, wanted: dict[tuple[str, str | None], Column], by: list[str]) -> DataFrame:
    """One aggregate, one row per metric."""
    named = {f"m{i}": key for i, key in enumerate(wanted)}
    wide = df.groupBy(*by).agg(*[wanted[key].alias(alias) for alias, key in named.items()])
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(column).cast("string").alias("column"),
            (F.lit(None) if metric == "checksum" else F.col(alias)).cast("double").alias("value"),
            (F.col(alias) if metric == "checksum" else F.lit(None)).cast("string").alias("text"),
        )
        for alias, (metric, column) in named.items()
    ]
    return wide.select(*by, F.inline(F.array(*entries)))


def evaluate_gate(metrics: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Violations of ``rules`` by ``metrics``: one row per failed rule with its message.

    A metric that was not computed, or computed to null, is a violation; an unknown rule type passes. ``by`` evaluates every
    rule for each distinct batch found in the metrics.
    """
    by = list(by or [])
    metric_of = F.lit(None).cast("string")
    for rule_type, metric in RULE_METRICS.items():
        metric_of = F.when(F.col("type") == rule_type, metric).otherwise(metric_of)
    known = rules.withColumn("_metric", metric_of).where("_metric IS NOT NULL")
    known = known.withColumn("_column", F.when(~F.col("type").isin("row_count_min", "checksum"), F.col("column")))
    if by:
        # Metrics of one batch are a few numbers: gather them as a map and hold every rule against it.
        # The rule list is fixed configuration, so it travels as one literal with each batch.
        return _evaluate_batches(metrics, known, by)
    found = metrics.select(
        F.col("metric").alias("_metric"), F.col("column").alias("_found"), F.col("value").alias("_value"),
        F.col("text").alias("_text"), (F.col("value").isNotNull() | F.col("text").isNotNull()).alias("_present"),
    )
    joined = known.join(found.withColumnRenamed("_metric", "_m"),
                        (F.col("_metric") == F.col("_m")) & F.col("_column").eqNullSafe(F.col("_found")), "left")
    return joined.select("rule_id", "type", "column", _message().alias("message")).where("message IS NOT NULL")


def _evaluate_batches(metrics: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    entry = F.struct(F.col("metric"), F.col("column"), F.col("value"), F.col("text"))
    batches = metrics.groupBy(*by).agg(F.collect_list(entry).alias("_metrics"))
    rules = "[" + ",".join(row[0] for row in known.select(F.to_json(F.struct("*"))).collect()) + "]"
    fields = {**RULE_FIELDS, "_metric": "string", "_column": "string"}
    kind = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">>"
    rows = batches.select(*by, "_metrics", F.inline(F.from_json(F.lit(rules), kind)))
    hit = "get(filter(_metrics, m -> m.metric = _metric AND m.column <=> _column), 0)"
    found = rows.withColumn("_hit", F.expr(hit)).selectExpr(
        *by, "rule_id", "type", "column", "value", "text",
        "(_hit.value IS NOT NULL OR _hit.text IS NOT NULL) AS _present", "_hit.value AS _value", "_hit.text AS _text",
    )
    return found.select(*by, "rule_id", "type", "column", _message().alias("message")).where("message IS NOT NULL")


def _number(value: str) -> str:
    """Counts print as whole numbers, anything else as it is."""
    return (
        f"CASE WHEN isnan({value}) THEN 'NaN' WHEN {value} = floor({value}) "
        f"THEN CAST(CAST({value} AS DECIMAL(38, 0)) AS STRING) ELSE CAST({value} AS STRING) END"
    )


# What a rule on a column says it found.
FINDINGS = {
    "not_null": "null(s)",
    "unique": "duplicate(s)",
    "accepted_values": "invalid value(s)",
    "referential_integrity": "orphan record(s)",
}


def _message() -> Column:
    """The violation text of a rule row joined to its metric, null when the rule holds.

    NaN is the greatest number here but fails every comparison where the rules come from, hence the guards.
    """
    threshold = "coalesce(value, 0.0D)"
    column = "'column \\'', coalesce(column, ''), '\\' has '"
    expected = f"coalesce(text, {_number('value')}, '')"
    actual = f"coalesce(_text, {_number('_value')}, '')"
    counted = " ".join(
        f"WHEN type = '{rule}' THEN CASE WHEN NOT isnan(_value) AND _value > 0 THEN "
        f"concat('VIOLATION {rule}: ', {column}, {_number('_value')}, ' {finding}') END"
        for rule, finding in FINDINGS.items()
    )
    return F.expr(f"""
        CASE WHEN NOT coalesce(_present, false) THEN concat('VIOLATION ', type, ': metric not computed/missing')
             WHEN type = 'row_count_min' THEN
               CASE WHEN isnan(_value) OR _value < {threshold}
                    THEN concat('VIOLATION row_count_min: got ', {_number('_value')}, ', expected >= ', {_number(threshold)})
               END
             {counted}
             WHEN type = 'null_pct_max' THEN
               CASE WHEN _value > {threshold}
                    THEN concat('VIOLATION null_pct_max: ', {column}, format_number(_value, 2), '% null(s), allowed ',
                                {_number(threshold)}, '%')
               END
             WHEN type = 'checksum' THEN
               CASE WHEN {actual} <> {expected}
                    THEN concat('VIOLATION checksum: got ', {actual}, ', expected ', {expected}) END
        END""")


def gate_verdict(violations: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Final status per run: quality_failed on any violation, else partial or success.

    ``runs`` has the key and ``optional_failures`` (a count). A run has at most one violation per rule.
    """
    per_run = violations.groupBy(key).agg(
        F.count("*").alias("n_violations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "message"))), lambda v: v["message"]),
                     "; ").alias("violations"),
    )
    failed = F.col("n_violations").isNotNull()
    return runs.join(per_run, key, "left").select(
        key,
        F.when(failed, "quality_failed").when(F.col("optional_failures") > 0, "partial").otherwise("success")
        .alias("status"),
        F.coalesce("n_violations", F.lit(0)).alias("n_violations"),
        F.coalesce("violations", F.lit("")).alias("violations"),
    )


def contract_violations(df: DataFrame, elements: list[Element], by: list[str] | None = None) -> DataFrame:
    """Nulls in each required column, required columns that are absent counting every row."""
    required = [e.name for e in elements if e.required]
    counts = [
        (null_count(name) if name in df.columns else F.count("*")).alias(name) for name in required
    ]
    wide = df.groupBy(*(by or [])).agg(*counts)
    return long_counts(wide, required, "null_rows", by).where("null_rows > 0")
