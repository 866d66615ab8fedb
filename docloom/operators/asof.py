"""Backward as-of lookup that stays parallel inside one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

HOUR = 3_600_000_000  # microseconds


def _band(df: DataFrame, name: str, width: int) -> Column:
    """Number of the band that an order value lies in: numbers as they are, timestamps by microseconds, dates by days.

    Only the band is rounded; values themselves are compared as they are."""
    kind = df.schema[name].dataType
    at = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.unix_micros(at.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    return F.floor(at / F.lit(width)).cast("bigint")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    tie_break: Sequence[str] = (),
    band: int = 4096,
) -> DataFrame:
    """Give each left row the ``payload`` of the last right row of the same key at or before it.

    The order axis is cut into bands of width ``band`` (pages, microseconds for timestamps, days for dates). Rows are
    shuffled and sorted by (key, band), so a key that holds a large part of the data is still spread over
    many tasks. What earlier bands contribute is one row per (key, band): the last right row of the nearest
    earlier band. Ties on the axis go to the highest ``tie_break``. Left rows without a match get nulls.

    Both inputs are read and shuffled once. The summary of each band is taken from the same shuffle as the
    lookup itself: it asks for the same columns, so Spark reuses the exchange. Key and band travel as one
    struct, which is never null; plain key columns would get a not-null filter on the summary side only and
    the two shuffles would no longer be the same.
    """

    def cell(df: DataFrame, on: str) -> Column:
        return F.struct(*[F.col(k) for k in by], _band(df, on, band).alias("__band")).alias("__cell")

    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        # One type for both, the wider one, so that values compare and fall into bands alike.
        common = left.select(F.col(left_on).alias("v")).union(right.select(F.col(right_on).alias("v"))).schema["v"].dataType
        right = right.withColumn(right_on, F.col(right_on).cast(common))
    else:
        common = left.schema[left_on].dataType

    rights = right.dropna(subset=[*by, right_on]).select(
        cell(right, right_on),
        F.col(right_on).alias("__at"),
        F.struct(*[F.col(c) for c in tie_break]).alias("__tie") if tie_break else F.lit(0).alias("__tie"),
        F.struct(*payload).alias("__value"),
    )
    wide = left.withColumn("__on", F.col(left_on).cast(common))
    lefts = wide.select(cell(wide, "__on"), F.col("__on").alias("__at"), F.struct(*left.columns).alias("__row"))
    is_left = F.col("__row").isNotNull()
    rows = rights.unionByName(lefts, allowMissingColumns=True).repartition("__cell")

    bands = rows.groupBy("__cell").agg(
        F.max_by("__value", F.when(~is_left, F.struct("__at", "__tie"))).alias("__latest"),
        F.count_if(is_left).alias("__asked"),
    )
    earlier = (
        W.Window.partitionBy(*[F.col(f"__cell.{k}") for k in by])
        .orderBy("__cell.__band")
        .rowsBetween(W.Window.unboundedPreceding, -1)
    )
    carried = (
        bands.withColumn("__carried", F.last("__latest", ignorenulls=True).over(earlier))
        .where((F.col("__asked") > 0) & F.col("__carried").isNotNull())
        .select("__cell", "__carried")
    )
    upto = (
        W.Window.partitionBy("__cell")
        .orderBy(F.col("__at").asc_nulls_first(), is_left, F.col("__tie"))
        .rowsBetween(W.Window.unboundedPreceding, 0)
    )
    value = F.coalesce(F.last("__value", ignorenulls=True).over(upto), F.col("__carried"))
    return (
        rows.join(carried, "__cell", "left")
        .withColumn("__value", value)
        .where(is_left)
        .select("__row.*", *[F.col(f"__value.{c}").alias(c) for c in payload])
    )
