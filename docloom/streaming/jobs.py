"""Streaming forms of the jobs: log levels and rule hits over files as they arrive, and tables kept up with a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import ingest, logs, rules


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Log files of a folder as a stream of lines with their level and message."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return logs.with_levels(lines.withColumnRenamed("value", "line"))


def hit_stream(
    spark: SparkSession, folder: str, found: Sequence[rules.Rule] = rules.DEFAULT_RULES, glob: str = "*.jsp",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Rule hits of source files as they arrive; a file is one document, named by its path."""
    files = (
        spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
        .text(folder, wholetext=True)
    )
    text = F.regexp_replace("value", r"\r\n?", "\n")
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), text.alias("text"))
    return rules.hits(docs, found)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop. Offsets live in ``checkpoint``, so a restart continues after it."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def keep_folded(stream: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keep ``fold`` of all rows that ever arrived as a table, process what has arrived, and stop.

    ``fold`` must give the columns it gets, and the same whether rows are folded at once or in steps: newest N, first of each key,
    last of each key. Batch k writes version k below ``path`` from version k-1 and its own rows, so only the folded table is read
    again, never earlier input. A batch that is repeated after a failure replaces its own version and counts nothing twice.
    Read the result with ``folded``.
    """

    def step(batch: DataFrame, k: int) -> None:
        rows = batch
        if k:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={k - 1}").unionByName(batch)
        fold(rows).write.mode("overwrite").parquet(f"{path}/version={k}")
        batch.sparkSession.range(k, k + 1, 1, 1).write.mode("overwrite").parquet(f"{path}/written/batch={k}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The newest version below ``path`` that was written to its end."""
    newest = spark.read.schema("id long").parquet(f"{path}/written/*").agg(F.max("id")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}")


def keep_newest(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str], order: Sequence[str], n: int = 1000) -> StreamingQuery:
    """The newest ``n`` rows per source of all that arrived."""
    return keep_folded(stream, path, checkpoint, lambda rows: ingest.latest(rows, by, order, n))


def keep_firsts(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """The first row of each key by ``order``, whenever it arrives. Rows of a key meet as partial aggregates."""
    names = stream.columns

    def fold(rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct(*names), F.struct(*order, *[c for c in names if c not in order]))
        return rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(first.alias("__row")).select("__row.*")

    return keep_folded(stream, path, checkpoint, fold)
