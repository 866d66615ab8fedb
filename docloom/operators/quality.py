"""Constraint checks. Spark does not enforce constraints, so a job asks for the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Sequence[str], nulls_allowed: bool = False) -> DataFrame:
    """Keys that occur more than once, with their count. Unique columns may hold many nulls."""
    rows = df.dropna(subset=list(key)) if nulls_allowed else df
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, primary_key: str) -> DataFrame:
    """Foreign keys without a parent, with the number of child rows that carry them.

    Counting first leaves one row per key for the join, however often a key is used.
    """
    used = child.dropna(subset=[foreign_key]).groupBy(foreign_key).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(F.col(primary_key).alias(foreign_key)), foreign_key, "left_anti").select(
        foreign_key, "n_rows"
    )


def not_null(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def too_long(c: str, limit: int = 255) -> Column:
    return F.count_if(F.length(c) > limit)


def not_decimal(c: str, precision: int = 10, scale: int = 2) -> Column:
    """Values that change when stored as DECIMAL(precision, scale), or that do not fit at all."""
    stored = F.col(c).try_cast(f"decimal({precision},{scale})").cast("double")
    return F.count_if(F.col(c).isNotNull() & (stored.isNull() | (stored != F.col(c).cast("double"))))


def column_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks in one pass over the table; one row with one count per check."""
    return df.agg(*[c.alias(n) for n, c in checks.items()])
