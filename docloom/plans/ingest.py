"""Row import, job selection, cell addresses and font rescaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import address as ad
from docloom.operators import grid, ingest
from docloom.sources.tables import read_table

FONT = "Brand#2"


def _sheet(spark, sf):
    """Parts as an import sheet: numeric keys read as doubles, padded names, values with forbidden characters."""
    return read_table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("No."),
        F.concat(F.lit("  "), "p_name", F.lit("/"), "p_brand", F.lit(":?"), "p_type", F.lit("\t ")).alias("value 1"),
        F.col("p_retailprice").alias("value 2"),
    )


def import_rows(spark, sf):
    return ingest.import_rows(_sheet(spark, sf), "No.", "value 1", "value 2", keep=["p_partkey"])


def import_rejects(spark, sf):
    """Turns as rows: system turns have no first value."""
    turns = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("role"), F.length("text").alias("n")
    )
    rows = ingest.import_rows(turns, "conv_id", "role", "n", keep=["conv_id", "turn"])
    return ingest.rejected(rows).select("conv_id", "turn", "no", "value1", "value2")


def import_paths(spark, sf):
    rows = ingest.import_rows(_sheet(spark, sf), "No.", "value 1", "value 2", keep=["p_partkey"])
    return ingest.output_files(rows, "p_partkey")


def _jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("done")
    return read_table(spark, sf, "orders").select("o_orderkey", status.alias("status"))


def job_tally(spark, sf):
    return ingest.tally(_jobs(spark, sf))


def job_failures(spark, sf):
    return ingest.failures(_jobs(spark, sf))


def incremental_pending(spark, sf):
    """Orders are sources; a shipped line is an output. Work is due when nothing shipped after the order."""
    sources = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("modified"))
    outputs = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_shipdate").alias("modified"))
    return ingest.pending(sources, outputs).select("name")


def a1_columns(spark, sf):
    letters = ad.column_letters(F.col("n"))
    return read_table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("n"), "p_size").withColumn("letters", letters).select(
        "n", "letters", ad.column_number(F.col("letters")).alias("back"),
        ad.column_offset(F.col("letters"), -5).alias("shifted"),
        ad.range_address(F.concat("letters", "p_size"), 2, 3).alias("area"),
    )


def _fonts(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_type").alias("sheet"), F.col("p_partkey").alias("cell"), F.col("p_brand").alias("font_name"),
        F.when(F.col("p_name") != "small ring", F.col("p_size")).alias("font_size"),
    )


def tiered_rescale(spark, sf):
    return grid.rescale_fonts(_fonts(spark, sf), FONT)


def tiered_rescale_counts(spark, sf):
    return grid.changed_counts(grid.rescale_fonts(_fonts(spark, sf), FONT))


QUERIES = {
    f.__name__: f
    for f in (
        import_rows, import_rejects, import_paths, job_tally, job_failures, incremental_pending, a1_columns,
        tiered_rescale, tiered_rescale_counts,
    )
}

def _letters_of(n: str) -> str:
    """SQL for the letters of column ``n``, up to five of them."""
    steps = [sum(26**j for j in range(k + 1)) for k in range(5)]
    return " || ".join(
        f"CASE WHEN {n} >= {steps[k]} THEN chr(CAST(65 + (({n} - {steps[k]}) // {26**k}) % 26 AS INTEGER)) ELSE '' END" for k in reversed(range(5))
    )


_RESCALED = """
    fonts AS (SELECT p_type AS sheet, p_partkey AS cell, p_brand AS font_name, CASE WHEN p_name <> 'small ring' THEN p_size END AS font_size FROM part),
    scaled AS (SELECT sheet, cell, 'Brand#2' AS font_name, font_name <> 'Brand#2' AS changed,
        CASE WHEN font_name = 'Brand#2' THEN CAST(font_size AS DOUBLE)
             WHEN coalesce(font_size, 11) >= 11 THEN floor(coalesce(font_size, 11)::DOUBLE * 0.9::DOUBLE * 2) / 2
             ELSE floor(font_size::DOUBLE * 0.85::DOUBLE * 2) / 2 END AS font_size FROM fonts)"""

ORACLES = {
    "import_rows": """
        SELECT p_partkey, CAST(p_size AS VARCHAR) AS no, p_name || '/' || p_brand || ':?' || p_type AS value1,
            regexp_replace(CAST(p_retailprice AS VARCHAR), '^\\s+', '') AS value2 FROM part""",
    "import_rejects": """
        SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS no, '' AS value1, CAST(length(text) AS VARCHAR) AS value2
        FROM conversations WHERE role = 'system'""",
    "import_paths": """
        SELECT p_size || '/' || p_name || '_' || p_brand || '_' || p_type || '.txt' AS path, any_value(CAST(p_size AS VARCHAR)) AS no,
            arg_max(CAST(p_retailprice AS VARCHAR), p_partkey) AS content FROM part GROUP BY 1""",
    "job_tally": """
        SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS skipped,
            count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders""",
    "job_failures": "SELECT o_orderkey, 'failed' AS status FROM orders WHERE o_orderstatus = 'P'",
    "incremental_pending": """
        SELECT o_orderkey AS name FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1)
            ON o_orderkey = l_orderkey WHERE done IS NULL OR done < o_orderdate""",
    "a1_columns": f"""
        SELECT n, {_letters_of("n")} AS letters, n AS back, CASE WHEN n > 5 THEN {_letters_of("(n - 5)")} END AS shifted,
            {_letters_of("n")} || p_size || ':' || {_letters_of("(n + 2)")} || (p_size + 1) AS area
        FROM (SELECT p_partkey + 1 AS n, p_size FROM part)""",
    "tiered_rescale": f"WITH {_RESCALED} SELECT sheet, cell, font_name, font_size, changed FROM scaled",
    "tiered_rescale_counts": f"WITH {_RESCALED} SELECT sheet, count(*) FILTER (changed) AS n_changed FROM scaled GROUP BY sheet",
}
