"""Grouped records, kinds, rendered text and log checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import group, ingest, logs
from docloom.sources.tables import read_table

EXPECTED = [("ERROR", "k=9.5"), ("CLICK", "type signup"), ("SIGNUP", "type signup"), ("INFO", "no such text")]


def _talks(spark, sf):
    return read_table(spark, sf, "conversations")


def group_records(spark, sf):
    found = group.group_records(_talks(spark, sf).select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return found.select("conv_id", "chunk", F.to_json("records").alias("records"))


def kind_rollup(spark, sf):
    talks = _talks(spark, sf)
    return group.last_by_kind(
        talks, talks, "conv_id", "turn", "role", "text", {"last_user": "user", "last_system": "system"}, {"n_assistant": "assistant"}
    )


def kind_lists(spark, sf):
    found = group.lists_by_kind(_talks(spark, sf), "conv_id", "turn", "role", "text", ["user", "assistant"])
    return found.select("conv_id", "role", "chunk", F.array_join("contents", "|").alias("contents"))


def render_group(spark, sf):
    lines = _talks(spark, sf).select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return group.render(lines, ["conv_id"], "turn", "line")


def spec_outline(spark, sf):
    """Conversations read as test specifications: users ask for requests, assistants give SQL checks."""
    kinds = tx.relabel(F.col("role"), {"user": group.REQUEST, "assistant": group.CHECK_SQL, "system": group.OVERVIEW})
    content = F.when(F.col("role") == "user", F.concat(F.lit("METHOD=GET\nURL=/c/"), "conv_id", F.lit("/"), "turn")).otherwise(F.lit("select 1"))
    steps = _talks(spark, sf).select(F.concat(F.lit("t."), "conv_id").alias("key"), "turn", kinds.alias("kind"), content.alias("content"))
    return group.spec_lines(steps, "key", "turn", "kind", "content")


def kv_lines(spark, sf):
    content = F.concat(
        F.lit("URL=/c/"), "conv_id", F.lit("\nMETHOD="), "role", F.lit("\nPOST_DATA=a="), "turn", F.lit("\nURL=/last?n="), "turn"
    )
    value = lambda p: tx.prefixed_value(F.col("content"), p)
    return _talks(spark, sf).withColumn("content", content).select(
        "conv_id", "turn", value("URL=").alias("url"), value("METHOD=").alias("method"),
        value("POST_DATA=").alias("post_data"), value("BODY=").alias("body"),
    )


def _log_lines(spark, sf):
    """Events as log lines; page views come without the level field."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_type") == "view", F.lit("] ")).otherwise(F.concat(F.lit("] ["), F.initcap("event_type"), F.lit("]")))
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("["), stamp, level, F.lit("type "), "event_type", F.lit(" k="), F.col("value").cast("string")).alias("line"),
    )


def log_levels(spark, sf):
    return logs.with_levels(_log_lines(spark, sf)).select("line_no", "level", "message")


def log_expectations(spark, sf):
    return logs.check_expectations(_log_lines(spark, sf), EXPECTED)


def latest_n(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ingest.latest(events, ["event_type"], ["ts", "event_id"], 1000).select("event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (group_records, kind_rollup, kind_lists, render_group, spec_outline, kv_lines, log_levels, log_expectations, latest_n)
}

_CHUNK = f"CAST(turn // {group.CHUNK} AS BIGINT)"
_LOG_SQL = """
    logs AS (SELECT event_id AS line_no, event_type,
        '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_type = 'view' THEN '] '
            ELSE '] [' || upper(event_type[1]) || event_type[2:] || ']' END
        || 'type ' || event_type || ' k=' || CAST(value AS VARCHAR) AS line,
        CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE upper(event_type) END AS level,
        'type ' || event_type || ' k=' || CAST(value AS VARCHAR) AS body FROM events)"""
_EXPECTED_SQL = "(VALUES " + ", ".join(f"({i}, '{lv}', '{t}')" for i, (lv, t) in enumerate(EXPECTED)) + ") e(check_no, expected, text)"

ORACLES = {
    "group_records": f"""
        SELECT conv_id, {_CHUNK} AS chunk,
            CAST(to_json(list({{'role': role, 'text': text}} ORDER BY turn)) AS VARCHAR) AS records
        FROM conversations GROUP BY ALL""",
    "kind_rollup": """
        SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_user,
            coalesce(arg_max(text, turn) FILTER (role = 'system'), '') AS last_system,
            count(*) FILTER (role = 'assistant') AS n_assistant
        FROM conversations GROUP BY conv_id""",
    "kind_lists": f"""
        SELECT conv_id, role, {_CHUNK} AS chunk, string_agg(text, '|' ORDER BY turn) AS contents
        FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL""",
    "render_group": f"""
        SELECT conv_id, {_CHUNK} AS chunk, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY ALL""",
    "spec_outline": f"""
        WITH g AS (SELECT 't.' || conv_id AS key, 'test_t_' || conv_id AS fn, conv_id, max(turn) FILTER (role = 'user') AS last_user,
                count(*) FILTER (role = 'system') AS n_sys, count(*) FILTER (role = 'assistant') AS n_check
            FROM conversations GROUP BY conv_id),
        heads AS (SELECT key, 0 AS part, list_filter(['def ' || fn || '():', CASE WHEN n_sys > 0 THEN '    ''''''select 1''''''' END,
                CASE WHEN n_sys = 0 AND last_user IS NULL THEN '    pass' END], lambda x: x IS NOT NULL) AS l FROM g
            UNION ALL
            SELECT key, 2, list_filter([CASE WHEN last_user IS NOT NULL THEN '    # HTTPリクエスト送信' END,
                '    url = ''/c/' || conv_id || '/' || last_user || '''', CASE WHEN last_user IS NOT NULL THEN '    method = ''GET''' END,
                CASE WHEN last_user IS NOT NULL THEN '    data = None' END,
                CASE WHEN n_check > 0 THEN '    # 判定用SQL' END], lambda x: x IS NOT NULL) FROM g)
        SELECT key, part, CAST(0 AS BIGINT) AS position, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM heads
        UNION ALL
        SELECT 't.' || conv_id, 3, turn, 0, '    # 判定SQL: select 1' FROM conversations WHERE role = 'assistant'""",
    "kv_lines": """
        SELECT conv_id, turn, '/last?n=' || turn AS url, role AS method, 'a=' || turn AS post_data, '' AS body FROM conversations""",
    "log_levels": f"WITH {_LOG_SQL} SELECT line_no, level, CASE WHEN event_type = 'view' THEN line ELSE body END AS message FROM logs",
    "log_expectations": f"""
        WITH {_LOG_SQL},
        firsts AS (SELECT check_no, arg_min(level, line_no) AS actual, arg_min(CASE WHEN event_type = 'view' THEN line ELSE body END, line_no) AS message
            FROM logs JOIN {_EXPECTED_SQL} ON contains(line, text) GROUP BY check_no)
        SELECT e.check_no, e.text, e.expected, actual, message,
            CASE WHEN actual IS NULL THEN 'missing' WHEN actual = e.expected THEN 'match' ELSE 'mismatch' END AS status
        FROM {_EXPECTED_SQL} LEFT JOIN firsts f ON e.check_no = f.check_no""",
    "latest_n": """
        SELECT event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000""",
}
