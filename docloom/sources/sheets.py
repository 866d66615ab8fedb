"""Sheets as long cell tables ``(sheet, row_no, col_no, value)`` and as CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.rows import join_one_per_key

WIDEST = 16_384  # fixed value: columns of a sheet

def read_csv_sheet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV export of one sheet with a header row. Without ``schema`` every column is text."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def header_of(cells: DataFrame, sheet: str, header_row: int = 1) -> dict[int, str]:
    """Column number to header text: one sheet's header row, at most as wide as a sheet."""
    rows = cells.where((F.col("sheet") == sheet) & (F.col("row_no") == header_row)).select("col_no", "value")
    found = rows.orderBy("col_no").limit(WIDEST + 1).collect()
    if len(found) > WIDEST:
        raise ValueError(f"row {header_row} of sheet {sheet} has more than {WIDEST} cells")
    return {r["col_no"]: r["value"] for r in found}


def named_cells(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """Cells below the header under the names that their own sheet's header row gives: sheet, row_no, name, value.

    Every sheet has its own header. Columns without a header cell are left out. A sheet with most rows is spread over tasks.
    """
    names = cells.where(F.col("row_no") == header_row).groupBy("sheet", "col_no").agg(F.max("value").alias("name"))
    below = cells.where(F.col("row_no") > header_row)
    return join_one_per_key(below, names, ["sheet", "col_no"], salt=F.col("row_no")).where(F.col("name").isNotNull()).select("sheet", "row_no", "name", "value")


def to_wide(cells: DataFrame, columns: dict[int, str], header_row: int = 1) -> DataFrame:
    """Long cells to one row per sheet row, columns named by ``columns``; the header row is dropped.

    The column list is known, so this is one hash aggregate per row and never a scan for values.
    """
    wanted = [F.max(F.when(F.col("col_no") == n, F.col("value"))).alias(name) for n, name in columns.items()]
    return (
        cells.where((F.col("row_no") > header_row) & F.col("col_no").isin(*columns))
        .groupBy("sheet", "row_no")
        .agg(*wanted)
    )


def to_cells(rows: DataFrame, sheet: str, row_no: str, columns: list[str]) -> DataFrame:
    """Wide rows to long cells; ``columns`` become columns 1, 2, ... and values become text."""
    cells = [
        F.struct(F.lit(i).alias("col_no"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(columns, start=1)
    ]
    # The array is never empty, so the inner form adds no filter.
    return rows.select(F.col(sheet).alias("sheet"), F.col(row_no).alias("row_no"), F.inline(F.array(*cells)))
