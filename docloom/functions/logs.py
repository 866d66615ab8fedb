"""Expressions over log lines ``[timestamp] [LEVEL]message`` and the job clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
LEVEL = r"^\[.*?\] \[(.*?)\]"
MESSAGE = r"(?s)^\[.*?\] \[.*?\](.*)$"


def log_level(line: Column) -> Column:
    """Upper-cased level, or UNKNOWN for lines without the two bracketed fields."""
    return F.when(line.rlike(LEVEL), F.upper(F.regexp_extract(line, LEVEL, 1))).otherwise(F.lit(UNKNOWN))


def log_message(line: Column) -> Column:
    """Text after the level field; the whole line when there is none."""
    return F.when(line.rlike(LEVEL), F.regexp_extract(line, MESSAGE, 1)).otherwise(line)


def as_of(override: str | None, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Job clock: ``override`` if it parses, otherwise the time of the query."""
    if not override:
        return F.current_timestamp()
    return F.coalesce(F.try_to_timestamp(F.lit(override), F.lit(fmt)), F.current_timestamp())
