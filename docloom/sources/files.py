"""File sources: discovery by suffix, whole-file text, term lists, file manifests."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

OFFICE_TEMPORARY = "~$"  # fixed value: prefix of the lock files that office programs leave behind
LISTED = "path string, millis long, length long, folder boolean"
CONTENT_BYTES = 1 << 24  # fixed value: contents that a task holds before it passes them on


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def discover(
    spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True, content: bool = False
) -> DataFrame:
    """Files below ``root`` with one of ``suffixes``: path, modified, length and, if asked, content.

    Without ``content`` the reader lists files and never opens them. Below a folder named by ``file:`` tasks list and read,
    when the rows are asked for, by the rules of Spark's reader: names that start with ``.`` or ``_`` and empty files do not
    count. All other roots are left to Spark's reader, which lists on the driver and deals out few files a task.
    """
    local = re.fullmatch("file:(?://)?(/[^/].*)", root)
    if recursive and local and os.path.isdir(local[1]) and not re.search(r"[*?\[\]{}\\^,]", "".join(suffixes)):
        files = _by_tasks(spark, re.sub("/+", "/", local[1]).rstrip("/"), suffixes, content)
    else:
        glob = "*" + suffixes[0] if len(suffixes) == 1 else "*{" + ",".join(suffixes) + "}"
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", str(recursive).lower())
            .load(root)
        )
    columns = ["path", F.col("modificationTime").alias("modified"), "length"]
    return files.where(~file_name(F.col("path")).startswith(OFFICE_TEMPORARY)).select(*columns, *(["content"] if content else []))


def _by_tasks(spark: SparkSession, top: str, suffixes: list[str], content: bool) -> DataFrame:
    """Files below a local or mounted folder, as Spark's ``binaryFile`` gives them.

    One task lists the top folder; the folders in it are dealt to tasks that walk down from there, and the files found are
    dealt out again to be read. Sizes in bytes say little about many small files, so the number of tasks is fixed.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = spark.createDataFrame([(top, 0, 0, True)], LISTED).mapInPandas(_walk(tuple(suffixes), False), LISTED)
    found = first.repartition(tasks, "path").mapInPandas(_walk(tuple(suffixes), True), LISTED).drop("folder")
    if content:
        found = found.repartition(tasks, "path").mapInPandas(_read(), "path string, millis long, length long, content binary")
    at = F.concat(F.lit("file:"), "path").alias("path")
    return found.select(at, F.timestamp_millis("millis").alias("modificationTime"), "length", *(["content"] if content else []))


def _walk(suffixes: tuple[str, ...], deep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Files in the folders given, in all folders below them if ``deep``; files given are passed on. No folder is held as a whole."""
    names = ["path", "millis", "length", "folder"]

    def walk(batches):  # an inner function, so that workers need not have this package
        for b in batches:
            yield b[~b["folder"]]
            todo, out = list(b["path"][b["folder"]]), []
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        aside = e.name.startswith("_") and "=" not in e.name
                        if e.name.startswith(".") or e.name.endswith("._COPYING_"):
                            continue
                        if e.is_dir():
                            if aside and not e.name.startswith(("_metadata", "_common_metadata")):
                                continue
                            if deep:
                                todo.append(e.path)
                            else:
                                out.append((e.path, 0, 0, True))
                        elif e.name.endswith(suffixes) and not aside:
                            try:
                                s = e.stat()
                            except FileNotFoundError:  # a link to nothing
                                continue
                            if s.st_size:
                                out.append((e.path, s.st_mtime_ns // 1_000_000, s.st_size, False))
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    return walk


def _read() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Files with their contents, passed on before they grow large."""

    def read(batches):
        for b in batches:
            held, first, size = [], 0, 0
            for i, path in enumerate(b["path"], 1):
                with open(path, "rb", 0) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= CONTENT_BYTES or i == len(b):
                    yield b.iloc[first:i].assign(content=held)
                    held, first, size = [], i, 0

    return read


def decode(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes to text; bytes that are wrong in the encoding become replacement characters.

    Code pages other than UTF-8 need the two ``spark.sql.legacy`` settings of ``docloom.session``.
    """
    if encoding.lower().replace("-", "") == "utf8":
        return F.make_valid_utf8(content.cast("string"))
    return F.decode(content, encoding)


def read_texts(
    spark: SparkSession, root: str, suffixes: list[str], encoding: str = "utf-8", recursive: bool = True
) -> DataFrame:
    """Whole files as ``(path, rel_path, text)``; line ends become ``\\n``."""
    text = tx.line_ends(decode(F.col("content"), encoding))
    return discover(spark, root, suffixes, recursive, content=True).select(
        "path", tx.relative_path(F.regexp_replace("path", r"^file:/+", "/"), root).alias("rel_path"), text.alias("text")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files of any size with their number in the file: ``(path, line_no, line)``, numbered from 0.

    Files are read in splits, by as many tasks as there are splits. A split's rows stand in file order in one task, so a line's
    place in its split needs no shuffle; a small table of lines per split, summed up file by file, gives where each split starts.
    ``\\n``, ``\\r\\n`` and ``\\r`` end a line; the line end at the end of a file starts no other line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("id") - F.col("first") + F.col("start")
    return lines.join(starts, ["path", "split"]).select("path", number.alias("line_no"), "line")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Term list file, one term a line, stripped, blank lines dropped: ``(seq, term)``, ``seq`` being the line in the file.

    The file may be of any size; it is read in splits.
    """
    lines = read_lines(spark, path).select(F.col("line_no").cast("int").alias("seq"), tx.strip(F.col("line")).alias("term"))
    return lines.where(F.length("term") > 0)


def manifest(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``(name, modified)`` per file, named by the relative path without its suffix."""
    rel = tx.relative_path(F.regexp_replace("path", r"^file:/+", "/"), root)
    return discover(spark, root, [suffix]).select(
        F.regexp_replace(rel, r"\.[^./]*$", "").alias("name"), "modified"
    )
