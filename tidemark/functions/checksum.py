"""Order-insensitive table checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def exact_hash(df: DataFrame, columns: list[str]) -> Column:
    """128 bits that tell any two different rows of these columns apart.

    Every value is written in full (a double by its shortest exact text, so NaN and the smallest change count) and
    preceded by its length; null is a mark of its own, never a text.
    """
    parts = []
    for name in columns:
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BinaryType):
            text = F.hex(value)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(value))
        else:
            text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts))


def checksum(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Aggregate column: the two 64-bit halves of each row's exact hash, summed apart, as one text.

    Rows count as often as they occur and in any order; any other value of any row changes it. The sums are DECIMAL(38),
    which 10^18 rows do not overflow. No rows sum to ``0:0``.
    """
    row = exact_hash(df, columns or df.columns)
    halves = [F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for at in (1, 17)]
    return F.concat_ws(":", *[F.coalesce(half, F.lit(0).cast("decimal(38,0)")).cast("string") for half in halves])
