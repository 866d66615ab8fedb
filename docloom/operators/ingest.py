"""Row import: validation, normalisation, output paths; incremental selection and job tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx


def named(column: str) -> Column:
    """Column by its exact name; sheet headers may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The DataFrame itself, or an error that names every missing column. Looks at the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def import_rows(df: DataFrame, no: str, value1: str, value2: str, keep: Sequence[str] = ()) -> DataFrame:
    """Sheet columns to the three normalised text fields ``no``, ``value1`` and ``value2``."""
    require_columns(df, [no, value1, value2])
    return df.select(
        *keep,
        tx.normalise_key(named(no)).alias("no"),
        tx.normalise_cell(named(value1)).alias("value1"),
        tx.normalise_cell(named(value2)).alias("value2"),
    )


def is_valid() -> Column:
    return (F.length("no") > 0) & (F.length("value1") > 0)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(is_valid())


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(~is_valid())


def output_files(rows: DataFrame, position: str) -> DataFrame:
    """One row per output path; of rows that write the same path the last one stays."""
    valid = accepted(rows).withColumn("path", tx.keyed_path(F.col("no"), F.col("value1")))
    last = F.max_by(F.struct("no", F.col("value2").alias("content")), F.col(position))
    return valid.groupBy("path").agg(last.alias("__row")).select("path", "__row.no", "__row.content")


def pending(sources: DataFrame, outputs: DataFrame, key: str = "name", modified: str = "modified") -> DataFrame:
    """Sources with no output, or with an output older than the source."""
    done = outputs.groupBy(key).agg(F.max(modified).alias("__done"))
    return (
        sources.join(done, key, "left")
        .where(F.col("__done").isNull() | (F.col("__done") < F.col(modified)))
        .select(*sources.columns)
    )


def tally(results: DataFrame, status: str = "status") -> DataFrame:
    """Totals of a batch job. A skipped input counts as a success."""
    failed = F.count_if(F.col(status) == "failed")
    return results.agg(
        F.count("*").alias("total"),
        (F.count("*") - failed).alias("succeeded"),
        F.count_if(F.col(status) == "skipped").alias("skipped"),
        failed.alias("failed"),
    )


def failures(results: DataFrame, status: str = "status") -> DataFrame:
    return results.where(F.col(status) == "failed")


def preview(df: DataFrame, position: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in source order."""
    return df.orderBy(*position).limit(n)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 1000, spread: int = 64) -> DataFrame:
    """The newest ``n`` rows per source.

    Two passes. Input splits are dealt to ``spread`` slices; each split keeps its newest ``n`` rows of a
    source before anything is shuffled, each slice then keeps its newest ``n``, and at last the slices
    meet. So the final step sees at most ``n * spread`` rows of any source, however large the source is.
    The result does not depend on how rows are sliced.
    """
    newest = [F.col(c).desc() for c in order]
    first = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*newest))
    final = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    sliced = df.withColumn("__slice", F.spark_partition_id() % spread)
    kept = sliced.withColumn("__rank", first).where(F.col("__rank") <= n).drop("__rank", "__slice")
    return kept.withColumn("__rank", final).where(F.col("__rank") <= n).drop("__rank")
