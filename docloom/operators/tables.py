"""Keyed table operators: navigation joins, upsert, delete, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_as(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Select under new names."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def navigate(child: DataFrame, parent: DataFrame, foreign_key: str, primary_key: str) -> DataFrame:
    """Child rows with their parent's columns; a null or unknown key keeps the row."""
    return child.join(parent, child[foreign_key] == parent[primary_key], "left")


def unique_or_fail(batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The batch itself, failing at run time if one key occurs twice.

    The check is a filter, so it is run whatever columns are used afterwards. Rows shuffle once by key.
    """
    rest = [c for c in batch.columns if c not in key]
    told = F.raise_error(F.lit("key occurs twice in one batch: " + ", ".join(key))).cast("boolean")
    return (
        batch.groupBy(*key).agg(F.first(F.struct(*(rest or key))).alias("__rest"), F.count("*").alias("__n"))
        .where(F.when(F.col("__n") > 1, told).otherwise(F.lit(True)))
        .select(*[F.col(c) if c in key else F.col(f"__rest.{c}").alias(c) for c in batch.columns])
    )


def upsert(base: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Base rows whose key is not in the batch, plus the whole batch; ``key`` is the primary key of ``base``.

    One full outer join: both tables are read and shuffled once. A null key matches nothing, so such rows are kept
    from both sides.
    """
    new = unique_or_fail(batch.select(*base.columns), list(key)).select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(key)], F.struct(*base.columns).alias("__new")
    )
    matches = [base[k] == F.col(f"__key{i}") for i, k in enumerate(key)]
    joined = base.join(new, matches, "full")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(base[c]).alias(c) for c in base.columns])


def delete_first(df: DataFrame, match: Sequence[str], primary_key: str) -> DataFrame:
    """Drop, per value of ``match``, the row with the lowest primary key.

    The lowest key is a partial aggregate, so a value that many rows share costs no more than any other,
    and the anti join runs on the primary key, which is unique.
    """
    first = df.dropna(subset=list(match)).groupBy(*match).agg(F.min(primary_key).alias(primary_key))
    return df.join(first.select(primary_key), primary_key, "left_anti").select(*df.columns)


def delete_first_where(df: DataFrame, column: str, value, primary_key: str) -> DataFrame:
    """Drop the first row, by primary key, where ``column`` equals ``value``; none matching is no error."""
    return df.join(
        where_equal(df, column, value).agg(F.min(primary_key).alias(primary_key)), primary_key, "left_anti"
    ).select(*df.columns)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name and number of rows."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def union_distinct(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union where each key appears once; the first frame that has it wins."""
    marked = [f.withColumn("__src", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, marked)
    rest = [c for c in frames[0].columns if c not in key]
    if not rest:
        return every.select(*key).distinct()
    return (
        every.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("__src", *rest)).alias("__rest"))
        .select(*[F.col(c) if c in key else F.col(f"__rest.{c}").alias(c) for c in frames[0].columns])
    )


def union_bag(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def without_names(df: DataFrame, column: str, excluded: Sequence[str], visible: str | None = None) -> DataFrame:
    """Drop listed names and, with ``visible``, rows that are hidden."""
    kept = df.where(~F.col(column).isin(*excluded)) if excluded else df
    return kept.where(F.col(visible)) if visible else kept


def referenced(df: DataFrame, references: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that something refers to. References are made distinct first, so a key that a large part of
    them shares is reduced before it is shuffled."""
    return df.join(references.select(*key).distinct(), list(key), "left_semi").select(*df.columns)


def not_in(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key was not processed before."""
    return df.join(done.select(*key).distinct(), list(key), "left_anti").select(*df.columns)
