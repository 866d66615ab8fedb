"""Cell-grid queries. Each document is a sheet: one row per line, with the line, its length, its first word and the language."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import grid
from docloom.operators.grid import Area
from docloom.operators.rows import explode_rows, spread
from docloom.sources import sheets
from docloom.sources.tables import read_table

BOX = Area(top=2, left=2, bottom=3, right=3)


def _cells(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "text"))
    rows = explode_rows(docs, ["doc_id", "lang"], F.split("text", "\n"), "pos", "line").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("row_no"), "line", F.length("line").alias("size"),
        F.substring_index("line", " ", 1).alias("word"), "lang",
    )
    return sheets.to_cells(rows, "doc_id", "row_no", ["line", "size", "word", "lang"])


def _sheets(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("sheet"))


def _template(spark, sf):
    nation = read_table(spark, sf, "nation").withColumn("row_no", F.col("n_nationkey") + 1)
    return sheets.to_cells(nation, "n_regionkey", "row_no", ["n_name", "n_regionkey"])


def sheet_scan(spark, sf):
    return sheets.to_wide(_cells(spark, sf), {1: "line", 3: "word"})


def sheet_named(spark, sf):
    """Cells under the names of their own sheet's first row."""
    return sheets.named_cells(_cells(spark, sf))


def find_row(spark, sf):
    return grid.find_row(_cells(spark, sf), 3, "The")


def find_col(spark, sf):
    return grid.find_col(_cells(spark, sf), 1, "en")


def section_slice(spark, sf):
    return grid.section(_cells(spark, sf), 3, "The", "Of")


def grid_set_value(spark, sf):
    return grid.set_value(_cells(spark, sf), BOX, "ID", _sheets(spark, sf))


def grid_delete_rows(spark, sf):
    return grid.delete_rows(_cells(spark, sf), 2, 4)


def grid_delete_cols(spark, sf):
    return grid.delete_cols(_cells(spark, sf), 2, 2)


def grid_delete_range(spark, sf):
    return grid.delete_range(_cells(spark, sf), BOX)


def grid_delete_range_left(spark, sf):
    return grid.delete_range(_cells(spark, sf), BOX, shift_left=True)


# Every sheet has a list of edits of its own; "i" is its number, "k" the step.
EDIT_STEPS = 40
EDITS = {
    "axis": "CASE WHEN (i + k) % 4 = 0 THEN 'col' ELSE 'row' END",
    "kind": "CASE WHEN (i + 2 * k) % 5 < 3 THEN 'insert' ELSE 'delete' END",
    "at": "CASE WHEN (i + k) % 4 = 0 THEN 1 + (i + k) % 3 ELSE 1 + (7 * i + 5 * k) % 30 END",
    "n": "1 + (i + k) % 2",
}


def grid_edit_lists(spark, sf):
    """Forty inserts and deletes of rows and columns in a row, other ones for every sheet but each seventh, which has none."""
    steps = read_table(spark, sf, "documents").where("doc_id % 7 <> 0").select(
        F.col("doc_id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(EDIT_STEPS))).alias("k")
    )
    edits = steps.select(F.col("i").alias("sheet"), F.col("k").alias("step"), *[F.expr(sql).alias(c) for c, sql in EDITS.items()])
    return grid.edit_lines(_cells(spark, sf), edits)


def grid_insert_range(spark, sf):
    return grid.insert_range(_cells(spark, sf), BOX)


def grid_insert_range_right(spark, sf):
    return grid.insert_range(_cells(spark, sf), BOX, shift_right=True)


def grid_insert_rows(spark, sf):
    return grid.insert_copied_rows(_cells(spark, sf), _template(spark, sf), 11, 13, 2, _sheets(spark, sf))


def grid_insert_cols(spark, sf):
    return grid.insert_copied_cols(_cells(spark, sf), _template(spark, sf), 2, 2, 1, _sheets(spark, sf))


def object_delete(spark, sf):
    docs = read_table(spark, sf, "documents")
    objects = docs.select("doc_id", F.concat("source", F.lit(" "), "lang").alias("name"), "text")
    return grid.delete_objects(objects, "en").select("doc_id", "name")


QUERIES = {
    f.__name__: f
    for f in (
        sheet_scan, sheet_named, find_row, find_col, section_slice, grid_set_value, grid_delete_rows, grid_delete_cols, grid_delete_range,
        grid_delete_range_left, grid_edit_lists, grid_insert_range, grid_insert_range_right, grid_insert_rows, grid_insert_cols, object_delete,
    )
}

CELLS = """
    lines AS (SELECT doc_id AS sheet, lang, unnest(string_split(text, chr(10))) AS t,
                     generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM documents),
    cells AS (SELECT sheet, row_no, 1 AS col_no, t AS value FROM lines
        UNION ALL SELECT sheet, row_no, 2, CAST(length(t) AS VARCHAR) FROM lines
        UNION ALL SELECT sheet, row_no, 3, string_split(t, ' ')[1] FROM lines
        UNION ALL SELECT sheet, row_no, 4, lang FROM lines)"""
_IN_BOX = "row_no BETWEEN 2 AND 3 AND col_no BETWEEN 2 AND 3"
_MARKS = """
    marks AS (SELECT sheet, min(row_no) FILTER (value = 'The') AS a, min(row_no) FILTER (value = 'Of') AS b
        FROM cells WHERE col_no = 3 GROUP BY sheet)"""

ORACLES = {
    "sheet_scan": f"WITH {CELLS} SELECT sheet, row_no, t AS line, string_split(t, ' ')[1] AS word FROM lines WHERE row_no > 1",
    "sheet_named": f"""
        WITH {CELLS} SELECT c.sheet, c.row_no, h.value AS name, c.value FROM cells c JOIN cells h
            ON c.sheet = h.sheet AND c.col_no = h.col_no WHERE h.row_no = 1 AND c.row_no > 1 AND h.value IS NOT NULL""",
    "find_row": f"WITH {CELLS} SELECT sheet, min(row_no) AS row_no FROM cells WHERE col_no = 3 AND value = 'The' GROUP BY sheet",
    "find_col": f"WITH {CELLS} SELECT sheet, min(col_no) AS col_no FROM cells WHERE row_no = 1 AND value = 'en' GROUP BY sheet",
    "section_slice": f"WITH {CELLS}, {_MARKS} SELECT c.* FROM cells c JOIN marks m ON c.sheet = m.sheet AND row_no >= a AND row_no < b",
    "grid_set_value": f"""
        WITH {CELLS} SELECT * FROM cells WHERE NOT ({_IN_BOX})
        UNION ALL SELECT doc_id, CAST(r.r AS BIGINT), CAST(c.c AS INTEGER), 'ID' FROM documents, (VALUES (2), (3)) r(r), (VALUES (2), (3)) c(c)""",
    "grid_delete_rows": f"""
        WITH {CELLS} SELECT sheet, CASE WHEN row_no > 4 THEN row_no - 3 ELSE row_no END AS row_no, col_no, value
        FROM cells WHERE row_no < 2 OR row_no > 4""",
    "grid_delete_cols": f"""
        WITH {CELLS} SELECT sheet, row_no, CASE WHEN col_no > 2 THEN col_no - 1 ELSE col_no END AS col_no, value FROM cells WHERE col_no <> 2""",
    "grid_delete_range": f"""
        WITH {CELLS} SELECT sheet, CASE WHEN col_no IN (2, 3) AND row_no > 3 THEN row_no - 2 ELSE row_no END AS row_no, col_no, value
        FROM cells WHERE NOT ({_IN_BOX})""",
    "grid_delete_range_left": f"""
        WITH {CELLS} SELECT sheet, row_no, CASE WHEN row_no IN (2, 3) AND col_no > 3 THEN col_no - 2 ELSE col_no END AS col_no, value
        FROM cells WHERE NOT ({_IN_BOX})""",
    "grid_edit_lists": f"""
        WITH RECURSIVE {CELLS}, w(k, sheet, row_no, col_no, value) AS (
            SELECT 0, * FROM (SELECT sheet, row_no, CAST(col_no AS BIGINT), value FROM cells) UNION ALL
            SELECT k, sheet, CASE WHEN axis = 'row' AND row_no >= a THEN row_no + d ELSE row_no END,
                CASE WHEN axis = 'col' AND col_no >= a THEN col_no + d ELSE col_no END, value
            FROM (SELECT *, CASE WHEN sheet % 7 = 0 THEN '' ELSE {EDITS['axis']} END AS axis, {EDITS['at']} AS a,
                    CASE WHEN {EDITS['kind']} = 'insert' THEN {EDITS['n']} ELSE -({EDITS['n']}) END AS d
                FROM (SELECT k + 1 AS k, sheet, sheet AS i, row_no, col_no, value FROM w WHERE k < {EDIT_STEPS}))
            WHERE NOT (d < 0 AND axis <> '' AND CASE axis WHEN 'row' THEN row_no ELSE col_no END BETWEEN a AND a - d - 1))
        SELECT sheet, row_no, CAST(col_no AS INTEGER) AS col_no, value FROM w WHERE k = {EDIT_STEPS}""",
    "grid_insert_range": f"""
        WITH {CELLS} SELECT sheet, CASE WHEN col_no IN (2, 3) AND row_no >= 2 THEN row_no + 2 ELSE row_no END AS row_no, col_no, value FROM cells""",
    "grid_insert_range_right": f"""
        WITH {CELLS} SELECT sheet, row_no, CASE WHEN row_no IN (2, 3) AND col_no >= 2 THEN col_no + 2 ELSE col_no END AS col_no, value FROM cells""",
    "grid_insert_rows": f"""
        WITH {CELLS} SELECT sheet, CASE WHEN row_no >= 2 THEN row_no + 3 ELSE row_no END AS row_no, col_no, value FROM cells
        UNION ALL SELECT doc_id, n_nationkey - 8, 1, n_name FROM documents, nation WHERE n_nationkey BETWEEN 10 AND 12
        UNION ALL SELECT doc_id, n_nationkey - 8, 2, CAST(n_regionkey AS VARCHAR) FROM documents, nation WHERE n_nationkey BETWEEN 10 AND 12""",
    "grid_insert_cols": f"""
        WITH {CELLS} SELECT sheet, row_no, col_no + 1 AS col_no, value FROM cells
        UNION ALL SELECT doc_id, n_nationkey + 1, 1, CAST(n_regionkey AS VARCHAR) FROM documents, nation""",
    "object_delete": """
        SELECT doc_id, source || ' ' || lang AS name FROM documents
        WHERE NOT (contains(source || ' ' || lang, 'en') OR contains(text, 'en'))""",
}
