"""Row order within keys, as a prefix scan over range partitions.

A window over a key sorts all rows of the key in one task, which fails once a key holds a large share of a large table. So
rows are dealt into segments by ranges of (keys, order), as many as their bytes ask for; a hot key lies in many of them.
Each segment is windowed by itself and written once, with what its rows know of the rows before them in the segment. A
key that goes on from one segment to the next needs one thing more, a carry of one row: the last row before the segment and
the totals up to it. Carries come from the first and the last row of every segment, so the written rows are read twice: for
those, and for the result. ``order`` must be a total order within a key; null keys equal each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SEGMENT = "_segment"

#: Bytes of a segment, by the optimizer's estimate; estimates of joins run high, so segments are bounded by tasks as well.
SEGMENT_BYTES, SEGMENTS_A_TASK = 64 << 20, 8


def segments_for(df: DataFrame) -> int:
    """Segments that the estimated bytes of a table ask for."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = SEGMENTS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-estimate // SEGMENT_BYTES), most))


class Ordered:
    """Rows of a table in order within keys, to which order-dependent columns are added by ``done``."""

    def __init__(self, df: DataFrame, order: list[str], keys: list[str] | None = None, segments: int | None = None):
        self.df, self.order, self.keys = df, order, list(keys or [])
        self.segments = segments or segments_for(df)
        self.before: dict[str, str] = {}
        self.sums: dict[str, Column] = {}
        self.added: list[str] = []

    def previous(self, columns: dict[str, str]) -> Ordered:
        """Add, for each ``{new_name: column}``, that column's value on the row before."""
        self.before.update(columns)
        self.added += columns
        return self

    def running_sum(self, sums: dict[str, Column]) -> Ordered:
        """Add running totals of whole-number expressions, the current row included; nulls add nothing.

        An expression may use the columns that ``previous`` adds.
        """
        self.sums.update(sums)
        self.added += sums
        return self

    def row_number(self, name: str = "row_number") -> Ordered:
        """Add the exact 1-based position within the key, or within the table when there are no keys."""
        return self.running_sum({name: F.lit(1)})

    def done(self) -> DataFrame:
        names = [*self.df.columns, *self.added]
        if self.segments == 1:
            return self._windowed(self.df, []).select(*names)
        dealt = self.df.repartitionByRange(self.segments, *self.keys, *self.order).withColumn(SEGMENT, F.spark_partition_id())
        rows = cut(self._windowed(dealt, [SEGMENT]), "segments")
        return self._carried(rows, self._carries(rows)).select(*names)

    def _payload(self) -> Column:
        return F.struct(*[F.col(c).alias(n) for n, c in self.before.items()])

    def _unpacked(self, df: DataFrame, payload: Column) -> DataFrame:
        return df.withColumns({n: payload[n] for n in self.before})

    def _value(self, name: str) -> Column:
        return F.coalesce(self.sums[name].cast("bigint"), F.lit(0).cast("bigint"))

    def _windowed(self, rows: DataFrame, inside: list[str]) -> DataFrame:
        """Rows with the columns added as far as their own segment tells; ``_first`` marks a key's first row there."""
        local = Window.partitionBy(*inside, *self.keys).orderBy(*self.order)
        if self.before:
            rows = self._unpacked(rows.withColumn("_prev", F.lag(self._payload()).over(local)), F.col("_prev"))
            rows = rows.withColumn("_first", F.col("_prev").isNull()).drop("_prev")
        upto = local.rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(self._value(name)).over(upto) for name in self.sums})

    def _carries(self, rows: DataFrame) -> DataFrame:
        """(segment, keys, previous row, shift of each sum) of the first key of each segment that goes on from an earlier one.

        A sum's value on that key's first row was taken without a previous row; the shift puts that right.
        """
        place = F.struct(*self.keys, *self.order)
        last = [self._payload().alias("_last")] if self.before else []
        tail = F.struct(*self.keys, *last, *[F.col(n).alias(f"_total_{n}") for n in self.sums])
        ends = rows.groupBy(SEGMENT).agg(
            F.min_by(F.struct(*self.df.columns), place).alias("_head"), F.max_by(tail, place).alias("_tail"))
        same = reduce(lambda a, b: a & b, [F.col(f"_head.{k}").eqNullSafe(F.col(f"_tail.{k}")) for k in self.keys], F.lit(True))
        # The first key of a segment takes over what the segments before it hold, the last one hands it on; often they are one.
        none = {name: F.lit(None).cast(ends.schema[name].dataType) for name in ("_head", "_tail")}

        def entry(key: str, head: Column, end: Column) -> Column:
            return F.struct(head.alias("_head"), end.alias("_tail"), *[F.col(f"{key}.{k}").alias(f"_key_{k}") for k in self.keys])

        whole, first = entry("_head", F.col("_head"), F.col("_tail")), entry("_head", F.col("_head"), none["_tail"])
        last = entry("_tail", none["_head"], F.col("_tail"))
        # One or two rows a segment. Without keys all are one chain, dealt by a column that is 0 everywhere.
        entries = ends.select(SEGMENT, F.inline(F.when(same, F.array(whole)).otherwise(F.array(first, last))))
        entries = entries.withColumn("_chain", F.shiftright(SEGMENT, 30))
        across = Window.partitionBy("_chain", *[f"_key_{k}" for k in self.keys]).orderBy(SEGMENT)
        carry = {"_at": F.lag(SEGMENT).over(across)}
        if self.before:
            carry["_carry"] = F.lag("_tail._last").over(across)
        entries = entries.withColumns(carry)
        shifts = entries.select("*", F.col("_head.*"))
        goes_on = F.col("_head").isNotNull() & F.col("_at").isNotNull()
        if self.before:
            none = self._unpacked(shifts, F.lit(None).cast(entries.schema["_carry"].dataType))
            none = none.withColumns({f"_bare_{n}": self._value(n) for n in self.sums})
            shifts = self._unpacked(none, F.col("_carry"))
            late = {f"_late_{n}": F.when(goes_on, self._value(n) - F.col(f"_bare_{n}")).otherwise(0) for n in self.sums}
        else:
            late = {f"_late_{n}": F.lit(0).cast("bigint") for n in self.sums}
        shifts = shifts.withColumns(late)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        shifts = shifts.withColumns({
            f"_shift_{n}": F.col(f"_late_{n}") + F.coalesce(F.sum(F.coalesce(F.col(f"_tail._total_{n}"), F.lit(0)) + F.col(f"_late_{n}")).over(earlier), F.lit(0))
            for n in self.sums})
        return shifts.where(goes_on).select(
            F.col(SEGMENT).alias("_at_segment"), *[f"_key_{k}" for k in self.keys], *(["_carry"] if self.before else []),
            *[f"_shift_{n}" for n in self.sums])

    def _carried(self, rows: DataFrame, carries: DataFrame) -> DataFrame:
        on = [F.col(SEGMENT) == F.col("_at_segment"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys]]
        # One row a segment at most.
        rows = rows.join(F.broadcast(carries), reduce(lambda a, b: a & b, on), "left")
        if self.before:
            late = F.col("_first") & F.col("_carry").isNotNull()
            rows = rows.withColumns({n: F.when(late, F.col(f"_carry.{n}")).otherwise(F.col(n)) for n in self.before})
        return rows.withColumns({n: F.col(n) + F.coalesce(F.col(f"_shift_{n}"), F.lit(0)) for n in self.sums})
