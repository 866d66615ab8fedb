"""Turning arrays into rows, and spreading small inputs over the cores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: Sequence[str], items: Column, pos: str, item: str) -> DataFrame:
    """One row per array element; rows with empty arrays disappear.

    The outer form plus a filter on the position is used on purpose: for the inner form Spark adds a filter
    on the array's size and pushes it to the scan, so an array that is costly to compute is computed twice.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def inline_rows(df: DataFrame, keep: Sequence[str], items: Column) -> DataFrame:
    """One row per array element with the element's fields as columns."""
    return explode_rows(df, keep, items, "__pos", "__item").select(*keep, "__item.*")


SMALL_SPLITS = 32  # at the default split size of 128 MB, 4 GB at most


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small table that is stored in fewer splits than there are cores.

    Only a table of at most ``SMALL_SPLITS`` splits is shuffled, before costly per-row work; a larger one is
    returned as it is. ``df`` must be a plain scan: its splits are known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores and splits <= SMALL_SPLITS else df


def join_one_per_key(df: DataFrame, lookup: DataFrame, key: Sequence[str], salt: Column, slices: int = 32, how: str = "inner") -> DataFrame:
    """Join with a table that has one row per key (inner, or left to keep all rows of ``df``), safe when few keys hold most rows of ``df``.

    Rows of a key are dealt to ``slices`` tasks by ``salt`` and the lookup row is repeated for each of them.
    Adaptive skew handling does not apply here when the lookup is itself an aggregate on the key.
    """
    dealt = df.withColumn("__slice", F.pmod(F.xxhash64(salt), F.lit(slices)).cast("int"))
    repeated = lookup.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt.join(repeated, [*key, "__slice"], how).drop("__slice")
