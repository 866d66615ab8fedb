"""Two-pass external shuffle into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import keep_columns, shared_folder

BUCKET_BYTES = 16 << 20
BUCKETS_PER_TASK = 2


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Highest random weight: each shard draws a number for the key and the largest wins, so one more shard takes
    rows only into itself."""
    draws = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["shard"]


def shuffle_into_shards(
    docs: DataFrame,
    row_id: Column,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 16,
    seed: int = 20_240_501,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows of ``docs`` in random order, with ``shard``, ``slot`` (gapless from 0 in the shard) and
    ``grown_shard`` (the shard if there were one more).

    Pass one scatters rows by a seeded hash of ``row_id`` into buckets of about ``bucket_bytes`` within their shard: a shard
    has as many buckets as its measured size asks for, so a key with most rows makes its shard's buckets many, not large.
    Two buckets that follow each other are one task. Pass two shuffles each bucket by Fisher-Yates (the ``shuffle``
    function) and numbers it. A bucket's rows are put in hash order first, so a repeated task gives the same order. The key
    alone decides the shard.

    ``row_id`` must tell rows apart and be the same at every evaluation (for files: path and row index); with it, copies
    of one row are spread over many buckets. Null keys share one shard. A null text counts as empty. An empty table
    gives an empty result. Input columns named shard, slot or grown_shard are replaced.
    """
    kept = keep_columns(docs, ["shard", "slot", "grown_shard"])
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    place = F.struct(shard_of(F.col(key), shards, seed).alias("shard"), shard_of(F.col(key), shards + 1, seed).alias("grown"))
    measured = docs.select(place["shard"].alias("shard"), size.cast("long").alias("size")).groupBy("shard").agg(F.sum("size").alias("bytes"))
    found = {r["shard"]: r["bytes"] for r in measured.collect()}  # one row per shard
    wanted = [max(1, -(-found.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(wanted[:s]) for s in range(shards)]
    buckets_of, first_of = (F.element_at(F.array(*map(F.lit, x)), F.col("place.shard") + 1) for x in (wanted, first))
    tasks = -(-sum(wanted) // BUCKETS_PER_TASK)
    draw = F.xxhash64(F.lit(seed + 1), row_id)
    dealt = (
        docs.select(F.struct(*kept).alias("row"), draw.alias("draw"), place.alias("place"))
        .withColumn("bucket", (first_of + F.pmod("draw", buckets_of)).cast("int"))
        .withColumn("task", F.floor(F.col("bucket") / BUCKETS_PER_TASK).cast("int"))
    )
    counts = dealt.groupBy("place.shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    gathered = (
        dealt.repartitionById(tasks, F.col("task"))
        .groupBy("task", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("draw", "place", "row"))).alias("rows"))
    )
    mixed = (
        gathered.join(offsets, "bucket")
        .sortWithinPartitions("bucket")
        .select("offset", F.shuffle("rows", seed + 2).alias("rows"))
    )
    return mixed.select("offset", F.posexplode("rows").alias("at", "r")).select(
        "r.row.*", F.col("r.place.shard").alias("shard"), (F.col("offset") + F.col("at")).alias("slot"), F.col("r.place.grown").alias("grown_shard")
    )


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard, in which a bucket's rows stand together and in slot order in one file, and give the table
    as it is read from there."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)


def op1_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__row"))
    sharded = shuffle_into_shards(known, F.col("__row")).select("doc_id", "text", "shard", "slot", "grown_shard")
    return write_shards(sharded, shared_folder(spark, "shards")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {}
