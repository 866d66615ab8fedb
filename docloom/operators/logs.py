"""Log checks. The same transforms serve batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.logs import log_level, log_message


def with_levels(lines: DataFrame) -> DataFrame:
    """Add level and message to rows with a ``line``."""
    return lines.select("*", log_level(F.col("line")).alias("level"), log_message(F.col("line")).alias("message"))


def check_expectations(lines: DataFrame, expectations: Sequence[tuple[str, str]]) -> DataFrame:
    """First line holding each text, and whether its level is the expected one.

    ``expectations`` are (level, text) pairs; ``lines`` are (line_no, line). Each text is one partial
    aggregate, so all of them are answered by a single pass. status: match, mismatch or missing.
    """
    firsts = [
        F.min_by(F.when(F.contains("line", F.lit(text)), F.col("line")), F.when(F.contains("line", F.lit(text)), F.col("line_no")))
        for _, text in expectations
    ]
    found = lines.agg(*[f.alias(f"f{i}") for i, f in enumerate(firsts)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("check_no"), F.lit(text).alias("text"), F.lit(level).alias("expected"), F.col(f"f{i}").alias("line"))
            for i, (level, text) in enumerate(expectations)
        ]
    )
    level = log_level(F.col("line"))
    return found.select(F.inline(rows)).select(
        "check_no", "text", "expected",
        F.when(F.col("line").isNotNull(), level).alias("actual"),
        log_message(F.col("line")).alias("message"),
        F.when(F.col("line").isNull(), "missing").when(level == F.col("expected"), "match").otherwise("mismatch").alias("status"),
    )
