"""Grouping rows into ordered record lists and text.

A group may be far larger than one task should hold, so lists and texts come in chunks of bounded size:
row ``(key, chunk)`` holds the records whose position falls into that chunk, in order. Groups below the
chunk size are one row; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import function_name, prefixed_value
from docloom.operators.rows import inline_rows

CHUNK = 1_000


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def group_records(df: DataFrame, key: str, position: str, chunk: int = CHUNK) -> DataFrame:
    """Records per key in source order, without the key itself; rows with a null key are left out."""
    rest = [c for c in df.columns if c not in (key, position)]
    packed = F.array_sort(F.collect_list(F.struct(position, *rest)))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key, chunk_of(F.col(position), chunk).alias("chunk"))
        .agg(packed.alias("records"))
        .select(key, "chunk", F.transform("records", lambda r: r.dropFields(position)).alias("records"))
    )


def last_by_kind(
    items: DataFrame, steps: DataFrame, key: str, position: str, kind: str, content: str, scalars: dict[str, str],
    counted: dict[str, str] | None = None,
) -> DataFrame:
    """One row per item: for each kind in ``scalars`` the content of its last step, empty if there is none.

    ``counted`` adds the number of steps of a kind. Steps without a kind are ignored and items without
    steps are kept. One scan and one shuffle of each table, as partial aggregates; ``items`` may be ``steps`` itself.
    """
    step = F.struct(F.col(position).alias("position"), F.col(kind).alias("kind"), F.col(content).alias("content"))
    if items is steps:
        rows = steps.select(key, step.alias("__step"), F.lit(True).alias("__item"))
    else:
        taken = steps.select(key, step.alias("__step"), F.lit(False).alias("__item"))
        rows = items.select(key, F.lit(None).cast(taken.schema["__step"].dataType).alias("__step"), F.lit(True).alias("__item")).unionByName(taken)
    # A null key names an item, but no steps belong to it.
    is_kind = lambda k: (F.col("__step.kind") == k) & F.col(key).isNotNull()
    last = [
        F.coalesce(F.max_by(F.when(is_kind(k), F.col("__step.content")), F.when(is_kind(k), F.col("__step.position"))), F.lit("")).alias(n)
        for n, k in scalars.items()
    ]
    counts = [F.count_if(is_kind(k)).alias(n) for n, k in (counted or {}).items()]
    rolled = rows.groupBy(key).agg(*last, *counts, F.bool_or("__item").alias("__item"))
    return rolled.where("__item").drop("__item")


def lists_by_kind(steps: DataFrame, key: str, position: str, kind: str, content: str, kinds: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Contents of the given kinds in order, one chunked list per (key, kind)."""
    return (
        steps.where(F.col(kind).isin(*kinds))
        .groupBy(key, kind, chunk_of(F.col(position), chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(position, content))).alias("packed"))
        .select(key, kind, "chunk", F.transform("packed", lambda r: r[content]).alias("contents"))
    )


def render(df: DataFrame, key: Sequence[str], position: str, line: str, chunk: int = CHUNK) -> DataFrame:
    """Lines of a group in order, joined by newlines, one text per chunk."""
    return (
        df.groupBy(*key, chunk_of(F.col(position), chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(position, line))).alias("packed"))
        .select(*key, "chunk", F.array_join(F.transform("packed", lambda r: r[line]), "\n").alias("text"))
    )


# The kinds of test-specification steps and the text each of them renders to.
OVERVIEW, VIEWPOINT, PRECONDITION = "概要", "観点", "前提条件"
SETUP_SQL, REQUEST, RESPONSE, CHECK_SQL = "事前準備_SQL", "手順_HTTPリクエスト", "判定方法_HTTPレスポンス", "判定方法_SQL"


def spec_lines(steps: DataFrame, key: str, position: str, kind: str, content: str) -> DataFrame:
    """Test outline per item as ordered lines: key, part, position, line_no, line.

    Single steps (overview, viewpoint, precondition, request, response) show their last value; SQL steps
    show all of theirs in order. An item without any step still gets its heading and a remark.
    """
    single = {"overview": OVERVIEW, "viewpoint": VIEWPOINT, "precondition": PRECONDITION, "request": REQUEST, "response": RESPONSE}
    many = {"n_setup": SETUP_SQL, "n_check": CHECK_SQL}
    rolled = last_by_kind(steps, steps, key, position, kind, content, single, many)
    told = lambda c, prefix, suffix="": F.when(F.length(c) > 0, F.concat(F.lit(prefix), F.col(c), F.lit(suffix)))
    req = lambda prefix: prefixed_value(F.col("request"), prefix)
    asked = F.length("request") > 0
    nothing = ~asked & (F.length("overview") == 0) & (F.length("response") == 0)
    data = F.when(F.length(req("POST_DATA=")) > 0, req("POST_DATA=")).otherwise("None")
    parts = {
        0: [F.concat(F.lit("def "), function_name(F.col(key)), F.lit("():")), told("overview", "    '''", "'''"),
            told("viewpoint", "    # 観点: "), told("precondition", "    # 前提条件: "),
            F.when(nothing, F.lit("    pass")), F.when(F.col("n_setup") > 0, F.lit("    # 事前準備SQL"))],
        2: [F.when(asked, F.lit("    # HTTPリクエスト送信")), F.when(asked, F.concat(F.lit("    url = '"), req("URL="), F.lit("'"))),
            F.when(asked, F.concat(F.lit("    method = '"), req("METHOD="), F.lit("'"))),
            F.when(asked, F.concat(F.lit("    data = "), data)),
            F.when(F.length("response") > 0, F.lit("    # HTTPレスポンス判定")), told("response", "    expected_response = "),
            F.when(F.col("n_check") > 0, F.lit("    # 判定用SQL"))],
    }
    numbered = lambda p: lambda line, i: F.struct(F.lit(p).alias("part"), i.alias("line_no"), line.alias("line"))
    told_lines = F.concat(*[F.transform(F.array_compact(F.array(*texts)), numbered(p)) for p, texts in parts.items()])
    heads = inline_rows(rolled, [key], told_lines).select(key, "part", F.lit(0).cast("bigint").alias("position"), "line_no", "line")
    sql = steps.where(F.col(kind).isin(SETUP_SQL, CHECK_SQL)).select(
        key, F.when(F.col(kind) == SETUP_SQL, 1).otherwise(3).alias("part"), F.col(position).cast("bigint").alias("position"),
        F.lit(0).alias("line_no"),
        F.concat(F.when(F.col(kind) == SETUP_SQL, "    # 実行SQL: ").otherwise("    # 判定SQL: "), content).alias("line"),
    )
    return heads.unionByName(sql)
