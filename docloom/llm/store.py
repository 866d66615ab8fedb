"""Written tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_ROWS = 500_000  # a list of rows of fixed width is sent to all executors up to this length and shuffled beyond it
MOST_BITS = 1 << 26  # of a table of bits that stands for a longer list; 8 MB, however long the list is
_BITS_A_ROW = 1 << 13
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom_package")
        context.addPyFile(shutil.make_archive(archive, "zip", root, "docloom"))
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; on
    a cluster the executors would not share one, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_lookup(df: DataFrame, lookup: DataFrame, key: Sequence[str], salt: Sequence[str], slices: int = 16, how: str = "inner") -> DataFrame:
    """Join with a table of at most one row per key where few keys may hold most rows of ``df``.

    Rows of a key are dealt to ``slices`` tasks by the columns of ``salt``; the lookup row is repeated for each. Spark counts the repeated
    table as no larger than the lookup and would send it through the driver; the hint keeps it from that.
    """
    dealt = df.withColumn("__slice", F.pmod(F.xxhash64(*salt), F.lit(slices)).cast("int"))
    repeated = lookup.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt.join(repeated.hint("merge"), [*key, "__slice"], how).drop("__slice")


def _bits(keys: DataFrame, code: Column, size: int) -> DataFrame:
    """A bit for each remainder of ``code`` by ``size``, set for those that are in ``keys``: part and its words of 64 bits; parts
    without any are left out."""
    place = keys.select(F.pmod(code, F.lit(size)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    n = _BITS_A_ROW // 64
    at = F.pmod("word", F.lit(n)).cast("int")
    parts = words.groupBy(F.shiftright("word", n.bit_length() - 1).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(at, "bits"))).alias("set"))
    return parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("long"))).alias("bits"))


def may_hold(df: DataFrame, keys: DataFrame, n: int, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``on`` columns are in ``keys``, a written table of ``n`` rows, and a few others (nulls equal nulls): what
    is left can be shuffled to meet ``keys`` where ``df`` could not.

    Of the others a share of ``n`` to the number of bits goes by, a sixteenth at most until there are ``MOST_BITS``."""
    code = F.xxhash64(*on)
    size = min(MOST_BITS, max(_BITS_A_ROW, 1 << (16 * n).bit_length()))
    table = F.broadcast(_bits(keys, code, size).withColumnsRenamed({"part": "__part", "bits": "__bits"}))
    place = F.pmod(code, F.lit(size))
    word = F.get("__bits", F.pmod(F.shiftright(place, 6), F.lit(_BITS_A_ROW // 64)).cast("int"))
    held = df.join(table, F.shiftright(place, _BITS_A_ROW.bit_length() - 1) == F.col("__part"))
    return held.where(F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1).drop("__part", "__bits")


def among(df: DataFrame, keys: DataFrame, on: list[str], most: int, salt: Sequence[str] = (), nullable: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` whose ``on`` columns are those of a row of ``keys``, a written table of distinct rows with these columns only.
    Nulls equal nulls in ``nullable``. With ``salt``, few keys may hold most rows.

    Up to ``most`` keys are sent to all executors. Of a longer list a table of bits is sent, and the rows it leaves are shuffled."""
    n = keys.count()
    if n > most:
        df = may_hold(df, keys, n, on)
        if salt:
            return salted_lookup(df, keys, on, salt)
    a, b = ([F.col(f"{x}.`{c}`") for c in on] for x in "ab")
    same = [x.eqNullSafe(y) if c in nullable else x == y for x, y, c in zip(a, b, on, strict=True)]
    return df.alias("a").join(keys.hint("merge" if n > most else "broadcast").alias("b"), same, "left_semi")


def keep_columns(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` that go on beside the columns an operator makes; a clashing input column is replaced."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def fields_of(df: DataFrame, columns: list[str]) -> str:
    """The schema text of some columns of ``df``."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def map_texts(df: DataFrame, make: Callable[[list[str | None]], dict[str, list]], schema: str, kept: list[str], text: str = "text") -> DataFrame:
    """The columns ``kept`` of ``df`` and those that ``make`` gives for its texts, one value per row.

    Kept columns stay Arrow arrays, so that integers beside nulls, decimals and times come back as they were. ``make``
    gets lists of texts and returns a list for each column of ``schema``.
    """
    asked = kept if text in kept else [*kept, text]
    out = f"{fields_of(df, kept)}, {schema}" if kept else schema
    made = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = make(b.column(text).to_pylist())
            columns = [b.column(c) for c in kept] + [pa.array(found[f.name], f.type) for f in made]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made.names])

    return df.select(*asked).mapInArrow(run, out)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write one file of the shared folder from a task: under a name of its own first, then renamed, so that a lost or
    repeated task leaves no half file."""
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    own = f"{root}/_{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{root}/{name}")


def read_range(folder: str, name: str, start: int, length: int) -> bytes:
    """Some bytes of one file of the shared folder."""
    files, root = _file_system(folder)
    with files.open_input_file(f"{root}/{name}") as f:
        return f.read_at(length, start)


def file_size(folder: str, name: str) -> int:
    files, root = _file_system(folder)
    return files.get_file_info(f"{root}/{name}").size


def make_folder(folder: str) -> None:
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
