"""Sinks: CSV reports, record JSON, keyed text files, table replacement."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_ORDER_MARK = "\ufeff"

# Report headings.
MIGRATION_HEADINGS = {
    "file": "対象ファイル",
    "line": "行番号",
    "line_count": "行数",
    "complexity": "難易度",
    "rule_name": "種類",
    "snippet": "該当コード/属性値（スニペット）",
    "raw": "生コード",
}
HIT_HEADINGS = {
    "term": "検索文字列",
    "file": "ファイル名",
    "heading": "ブックマーク",
    "page_no": "ページ",
    "context": "ヒット箇所",
}
OUTLINE_HEADINGS = {"file": "ファイル名", "title": "ブックマーク"}

# Table-schema names of Spark types.
SCHEMA_TYPES = {
    T.ByteType: "integer",
    T.ShortType: "integer",
    T.IntegerType: "integer",
    T.LongType: "integer",
    T.FloatType: "number",
    T.DoubleType: "number",
    T.DecimalType: "number",
    T.BooleanType: "boolean",
    T.DateType: "datetime",
    T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime",
}


def write_csv_report(
    df: DataFrame,
    path: str,
    headings: dict[str, str],
    quote_all: bool = False,
    encoding: str = "UTF-8",
    byte_order_mark: bool = False,
) -> None:
    """Write the columns named in ``headings`` under their headings, quotes doubled inside values.

    The byte-order mark rides on the first heading, so every part file starts with it.
    Order the rows before the call where the report has an order; parts keep it.
    """
    names = list(headings)
    titles = [headings[n] for n in names]
    if byte_order_mark:
        titles[0] = BYTE_ORDER_MARK + titles[0]
    (
        df.select(*[F.col(n).alias(t) for n, t in zip(names, titles)])
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("emptyValue", '""' if quote_all else "")
        .option("encoding", encoding)
        .csv(path)
    )


def record_json(*columns: str | Column) -> Column:
    """One JSON document per row."""
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})


def table_schema(df: DataFrame, key: str) -> dict:
    """Table-schema description of a DataFrame: fields, their types and the key column."""
    fields = [{"name": f.name, "type": SCHEMA_TYPES.get(type(f.dataType), "string")} for f in df.schema.fields]
    return {"fields": fields, "primaryKey": [key]}


def write_table_json(df: DataFrame, path: str, key: str) -> None:
    """Rows as JSON lines under ``data`` and the table schema as one small file under ``schema``."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/data")
    spark = df.sparkSession
    line = json.dumps(table_schema(df, key), ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def table_json_lines(df: DataFrame, key: str) -> DataFrame:
    """Schema and rows as the lines of one JSON document: ``(part, key, line)``; rows stand by ``key``, which is unique.

    The document is ``{"schema": ..., "data": [...]}``. Only the first row has no comma before it; it is found by its key.
    """
    opening = json.dumps(table_schema(df, key), ensure_ascii=False)
    first = df.agg(F.min(F.struct(F.col(key)))).scalar()
    comma = F.when(F.struct(F.col(key)).eqNullSafe(first), "").otherwise(",")
    rows = df.select(F.lit(1).alias("part"), F.col(key).alias("key"), F.concat(comma, record_json()).alias("line"))
    kind = df.schema[key].dataType
    edges = df.sparkSession.createDataFrame([(0, f'{{"schema": {opening}, "data": ['), (2, "]}")], "part int, line string")
    return rows.unionByName(edges.select("part", F.lit(None).cast(kind).alias("key"), "line"))


def write_ordered_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as one text in parts: each part holds a run of ``order``, and the parts, joined by name, are the text.

    Many tasks write, so a text of any size can be written, with one heading or one JSON document around all of it.
    """
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def csv_lines(df: DataFrame, headings: dict[str, str], order: list[str]) -> DataFrame:
    """A CSV report as lines with one heading: ``(part, *order, line)``, for ``write_ordered_lines``.

    All values are quoted, quotes doubled; null is empty. A value may hold line ends.
    """
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in headings]
    rows = df.select(F.lit(1).alias("part"), *order, F.concat_ws(",", *quoted).alias("line"))
    heading = ",".join('"' + h.replace('"', '""') + '"' for h in headings.values())
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    top = df.sparkSession.createDataFrame([(0, heading)], "part int, line string")
    return rows.unionByName(top.select("part", *nothing, "line"))


def write_keyed_text(df: DataFrame, path: str, keys: list[str], content: str, order: list[str] | None = None) -> None:
    """Text under one folder per key (``no=1/name=a/``).

    Rows are range-partitioned by key and ``order``: each task writes a run of neighbouring keys, so there
    are about as many files as keys, and a key with very many rows is written by several tasks whose parts
    sort by name. Give ``order`` where the text of a key is a report of many lines.
    """
    by = [*keys, *order] if order else [*keys, content]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed.select(*keys, F.col(content).cast("string").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_files(df: DataFrame, root: str, path: str, content: str, order: list[str] | None = None) -> str:
    """One file per value of ``path`` below ``root``, at exactly that place: ``1/a_b.txt``, ``src/x.jsp.txt``.

    Without ``order`` there is one row per path and its content is the file. With ``order`` the rows of a path are the lines of
    a report: they are sorted in their task and written one after the other, so a report is never held as a whole. Null paths
    are left out, null contents count as empty. ``root`` is a folder that the tasks can reach, a path or a URI that Arrow's file
    systems know.

    Nothing is seen below ``root`` before every file is written. Tasks write aside, in a folder of this call, and return the
    names as rows of a table; Spark commits of each task the rows of one attempt only. A second job then moves the files that
    this table names, so a lost, repeated or late task neither shows half a file nor replaces one that was published. If the
    first job fails, ``root`` is as before. Returns ``root`` as a URI.
    """
    spark, at = df.sparkSession, _uri(root)
    aside = f"{at}/.writing-{uuid.uuid4().hex}"
    rows = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("string").alias("text"), *(order or []))
    placed = rows.repartition("path").sortWithinPartitions("path", *order) if order else rows
    written = placed.select("path", "text").mapInPandas(_write_aside(aside, "\n" if order else ""), WRITTEN)
    try:
        written.write.parquet(f"{aside}/written")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        named = spark.read.schema(WRITTEN).parquet(f"{aside}/written").repartition(tasks, "path")
        named.mapInPandas(_publish(at), "files long").write.format("noop").mode("overwrite").save()
    finally:
        files, folder = fs.FileSystem.from_uri(aside)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)
    return at


WRITTEN = "path string, aside string"


def _uri(root: str) -> str:
    """A folder under the name that Spark and Arrow read alike; a path without a scheme is a local or mounted one."""
    local = root.removeprefix("file:")
    named = root if "://" in root else "file://" + posixpath.abspath(local)
    return named.rstrip("/")


def _write_aside(aside: str, end: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Write neighbouring rows of one path to a file of their own; gives the path and the file.

    Each attempt of a task has a folder of its own: tasks that make files in one folder wait for each other. The lines of a
    path are written batch by batch, not one by one.
    """

    def write(batches):  # an inner function, so that workers need not have this package
        files, top = fs.FileSystem.from_uri(aside)
        own = f"{top}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        at, out, lines, n = None, None, [], 0
        for b in batches:
            done = []
            for where, text in zip(b["path"].tolist(), b["text"].tolist()):
                if where != at or not end:
                    if out is not None:
                        out.write("".join(lines).encode("utf-8", "surrogatepass"))
                        out.close()
                        done.append((at, f"{own}/{n}"))
                    at, lines, n = where, [], n + 1
                    out = files.open_output_stream(f"{own}/{n}")
                lines += (text or "", end)
            if out is not None:
                out.write("".join(lines).encode("utf-8", "surrogatepass"))
                lines = []
            yield pd.DataFrame(done, columns=["path", "aside"])
        if out is not None:
            out.close()
            yield pd.DataFrame([(at, f"{own}/{n}")], columns=["path", "aside"])

    return write


def _publish(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Move files to their places. A file that is no longer aside was moved by an earlier attempt of the task.

    A local file system moves one file at a time between folders, whatever the number of tasks. A second name (a hard link)
    and the end of the first do not wait for each other; where that fails, files are moved.
    """

    def publish(batches):
        files, top = fs.FileSystem.from_uri(root)
        local = isinstance(files, fs.LocalFileSystem)
        for b in batches:
            for where, own in zip(b["path"].tolist(), b["aside"].tolist()):
                target = posixpath.join(top, where)
                try:
                    if local:
                        os.link(own, target)
                        os.unlink(own)
                    else:
                        files.move(own, target)
                    continue
                except OSError:  # the first file of its folder, one that replaces another, or no links here
                    files.create_dir(posixpath.dirname(target), recursive=True)
                try:
                    files.move(own, target)
                except OSError:
                    both = files.get_file_info([own, target])
                    if both[0].type != fs.FileType.NotFound or both[1].type == fs.FileType.NotFound:
                        raise
            yield pd.DataFrame({"files": [len(b)]})

    return publish


def report_path(rel_path: Column, suffix: str = ".jsp.txt") -> Column:
    """Where the report of a source file goes: the same place in the output tree, with the suffix replaced."""
    return F.concat(F.regexp_replace(rel_path, r"\.[^./]*$", ""), F.lit(suffix))


def replace_table(spark: SparkSession, df: DataFrame, path: str, version: str) -> str:
    """Write a new version beside the versions that readers may still hold; returns its path.

    A table is never overwritten while it is being read. Pointing readers at the returned path is the
    commit; a failed job leaves the old version untouched.
    """
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version below ``path``: versions are partition folders, so only their names are listed."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == F.lit(newest)).drop("version")
