"""Cell addresses (``A1``), column letters and ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = 14  # enough for every bigint


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def column_letters(n: Column) -> Column:
    """Number to letters (1 is A, 27 is AA). Numbers below 1 give an empty text.

    With ``k`` letters to its right, a letter starts at ``1 + 26 + ... + 26**k``; its value repeats
    every ``26**(k+1)`` columns. Each letter is therefore independent of the others.
    """
    return _once(n.cast("bigint"), _letters)


def _letters(n: Column) -> Column:
    parts = []
    for k in reversed(range(LETTERS)):
        first = sum(26**j for j in range(k + 1))
        digit = F.call_function("div", n - first, F.lit(26**k)) if k else n - first
        letter = F.char((F.lit(65) + F.pmod(digit, F.lit(26))).cast("bigint"))
        parts.append(F.when(n >= first, letter).otherwise(""))
    return F.when(n.isNotNull(), F.concat(*parts))


def column_number(letters: Column) -> Column:
    """Letters to number; anything that is not a letter is ignored."""
    clean = F.regexp_replace(F.upper(letters), "[^A-Z]", "")
    return F.when(F.length(clean) == 0, F.lit(0).cast("bigint")).otherwise(
        F.aggregate(F.split(clean, ""), F.lit(0).cast("bigint"), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    )


def column_offset(base: Column, offset: Column | int) -> Column:
    """Letters of the column ``offset`` steps away; null when that lies left of column A."""
    return _once(column_number(base) + F.lit(offset), lambda target: F.when(target >= 1, _letters(target)))


def range_address(cell: Column, rows: Column | int, cols: Column | int) -> Column:
    """``A1`` with 2 rows and 3 columns is ``A1:C2``; null when ``cell`` is no address."""
    letters = F.regexp_extract(cell, r"^([A-Za-z]+)(\d+)", 1)
    first_row = F.regexp_extract(cell, r"^([A-Za-z]+)(\d+)", 2)
    last_col = column_letters(column_number(letters) + F.lit(cols) - 1)
    last_row = first_row.try_cast("bigint") + F.lit(rows) - 1
    return F.when(cell.rlike(r"^[A-Za-z]+\d"), F.concat(cell, F.lit(":"), last_col, last_row.cast("string")))


def rescaled_size(
    size: Column, pivot: float = 11, ratio_from_pivot: float = 0.9, ratio_below: float = 0.85
) -> Column:
    """New font size: tiered ratio, rounded down to halves. A missing size counts as ``pivot``."""
    s = F.coalesce(size.cast("double"), F.lit(float(pivot)))
    ratio = F.when(s >= pivot, F.lit(ratio_from_pivot)).otherwise(F.lit(ratio_below))
    return F.floor(s * ratio * 2).cast("double") / 2
