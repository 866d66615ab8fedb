"""Sinks and file sources: whole tables are written below the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import search as se
from docloom.operators.rows import explode_rows
from docloom.sources import files, sinks
from docloom.sources.tables import read_table

INLINE = ["that of", "license"]
HEADINGS = {"p_partkey": "No.", "p_name": "name", "p_brand": 'brand "B"', "p_size": "size"}


def _scratch(spark, name):
    """A new folder below ``spark.checkpoint.dir``. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def _lines(spark, sf):
    """Lines of documents; carriage returns end lines too."""
    text = tx.line_ends(F.coalesce("text", F.lit("")))
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", text.alias("text"))
    return explode_rows(docs, ["doc_id", "lang"], F.split("text", "\n"), "pos", "line")


def table_json(spark, sf):
    """Customers with their table schema as the lines of one JSON document."""
    return sinks.table_json_lines(read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")


def csv_report(spark, sf):
    """Parts as a report in several ordered parts with one heading, read back as text lines."""
    lines = sinks.csv_lines(read_table(spark, sf, "part"), HEADINGS, ["p_partkey"])
    to = _scratch(spark, "csv")
    sinks.write_ordered_lines(lines, to, ["part", "p_partkey"])
    return spark.read.text(to).select(F.col("value").alias("line"))


def text_lines(spark, sf):
    """Documents written as text files and read in splits; lines counted from the first line of their document."""
    value = F.concat_ws(":", "doc_id", "line").alias("value")
    to = _scratch(spark, "lines")
    _lines(spark, sf).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "pos").select(value).write.text(to)
    read = files.read_lines(spark, to).select(
        F.substring_index("line", ":", 1).cast("bigint").alias("doc_id"), "line_no", F.regexp_replace("line", "^[^:]*:", "").alias("line")
    )
    first = F.min("line_no").over(Window.partitionBy("doc_id"))
    return read.select("doc_id", (F.col("line_no") - first).alias("in_doc"), "line")


def report_files(spark, sf):
    """One file per document below a folder per language, written line by line and read back."""
    to = _scratch(spark, "reports")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat("doc_id", F.lit(".txt")))
    at = sinks.write_files(_lines(spark, sf).withColumn("path", path), to, "path", "line", order=["pos"])
    back = files.read_texts(spark, at, [".txt"])
    return back.select(F.substring_index("path", "/", -2).alias("file"), "text")


def keyed_texts(spark, sf):
    """Names of parts as text under a folder per brand, read back."""
    to = _scratch(spark, "keyed")
    sinks.write_keyed_text(read_table(spark, sf, "part"), to, ["p_brand"], "p_name", order=["p_partkey"])
    return spark.read.text(to).select("p_brand", F.col("value").alias("p_name"))


def table_versions(spark, sf):
    """Orders replaced by a version without those that are pending; readers get the newest version."""
    orders, to = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _scratch(spark, "orders")
    sinks.replace_table(spark, orders, to, "2024-01-01")
    sinks.replace_table(spark, sinks.latest_version(spark, to).where("o_orderstatus <> 'P'"), to, "2024-01-02")
    return sinks.latest_version(spark, to)


def search_term_file(spark, sf):
    """Inline terms and those of a term file, the lines of the benchmark passages, in whole documents."""
    to = _scratch(spark, "terms")
    read_table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).distinct().write.text(to)
    terms = se.term_table(INLINE, files.read_terms(spark, to))
    pages = read_table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    return se.find_terms(pages, terms).select("doc_id", "term").distinct()


QUERIES = {f.__name__: f for f in (table_json, csv_report, text_lines, report_files, keyed_texts, table_versions, search_term_file)}

_TEXT = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SCHEMA = (
    '{"schema": {"fields": [{"name": "c_custkey", "type": "integer"}, {"name": "c_name", "type": "string"}, '
    '{"name": "c_nationkey", "type": "integer"}], "primaryKey": ["c_custkey"]}, "data": ['
)
_QUOTED = " || ',' || ".join(f"""'"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"'""" for c in HEADINGS)
_HEADING = ",".join('"' + h.replace('"', '""') + '"' for h in HEADINGS.values())

ORACLES = {
    "table_json": f"""
        SELECT 1 AS part, c_custkey AS key, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN '' ELSE ',' END
            || CAST(to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}}) AS VARCHAR) AS line FROM customer
        UNION ALL SELECT 0, NULL, '{_SCHEMA}' UNION ALL SELECT 2, NULL, ']}}'""",
    "csv_report": f"SELECT {_QUOTED} AS line FROM part UNION ALL SELECT '{_HEADING}'",
    "text_lines": f"""
        SELECT doc_id, CAST(generate_subscripts(string_split({_TEXT}, chr(10)), 1) - 1 AS BIGINT) AS in_doc,
            unnest(string_split({_TEXT}, chr(10))) AS line FROM documents""",
    "report_files": f"SELECT coalesce(lang, 'none') || '/' || doc_id || '.txt' AS file, {_TEXT} || chr(10) AS text FROM documents",
    "keyed_texts": "SELECT p_brand, p_name FROM part",
    "table_versions": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
    "search_term_file": f"""
        WITH terms AS (SELECT DISTINCT {_STRIP.format("line")} AS term FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)
                       UNION SELECT unnest({INLINE}))
        SELECT DISTINCT doc_id, term FROM documents JOIN terms ON length(term) > 0 AND contains(replace(text, chr(10), ' '), term)""",
}
