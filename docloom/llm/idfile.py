"""Token ids in files: frequency ranks, byte-aligned variable-length codes, control bytes apart from data bytes.

One file holds whole documents in ascending order of their key:

    8 bytes   magic
    3 x u64   documents, ids, distinct ids
    i64 each  document keys, then u8 each: key is null
    u64 each  ids per document
    u32 each  distinct ids, the most frequent first (ties: smaller id first)
    u8 each   control bytes: four 2-bit codes for four ids, lowest bits first; code + 1 is the number of data bytes
    data      ranks, little-endian, in as few bytes as they need
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import put_file, shared_folder, ship_package, staged
from docloom.llm.tokens import tokenizer

MAGIC = b"DLIDS\x00\x01\n"
FILE_IDS = 4 << 20  # a file is closed when it has as many; one document is never split
STEP = 1 << 18  # control bytes decoded at once
# Data bytes of each of the four ids of a control byte.
SIZES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
SUMS = SIZES.sum(1).astype(np.int64)


def encode_file(keys: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One file; ``ids`` are the ids of all documents in a row."""
    values, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -times))
    rank_of = np.empty(len(values), np.uint32)
    rank_of[order] = np.arange(len(values), dtype=np.uint32)
    control, data = [], []
    for at in range(0, len(ids), 4 * STEP):
        ranks = rank_of[back[at : at + 4 * STEP]].astype("<u4")
        sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
        data.append(ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]].tobytes())
        codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
        codes[: len(ranks)] = sizes - 1
        control.append((codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
    head = np.array([len(keys), len(ids), len(values)], "<u8").tobytes()
    named = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes()
    return b"".join([MAGIC, head, named, np.array(counts, "<u8").tobytes(), values[order].astype("<u4").tobytes(), *control, *data])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids per document and all ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, distinct = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    keys = np.frombuffer(raw, "<i8", n, at).tolist()
    empty = np.frombuffer(raw, np.uint8, n, at := at + 8 * n)
    counts = np.frombuffer(raw, "<u8", n, at := at + n).astype(np.int64)
    values = np.frombuffer(raw, "<u4", distinct, at := at + 8 * n)
    groups = -(-total // 4)
    control = np.frombuffer(raw, np.uint8, groups, at := at + 4 * distinct)
    data = np.concatenate([np.frombuffer(raw, np.uint8, -1, at + groups), np.zeros(4, np.uint8)])
    ids, begin = np.empty(groups * 4, np.uint32), 0
    for g in range(0, groups, STEP):
        part = control[g : g + STEP]
        sizes = SIZES[part].ravel()
        ends = begin + np.cumsum(sizes, dtype=np.int64)
        places = ends - sizes
        if g + STEP >= groups:  # ids that only fill the last control byte have no data
            places, sizes = places[: total - 4 * g], sizes[: total - 4 * g]
        ranks = np.zeros(len(places), np.uint32)
        for k in range(4):
            ranks |= np.where(sizes > k, data[np.minimum(places + k, len(data) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
        ids[4 * g : 4 * g + len(places)] = values[ranks]
        begin += int(SUMS[part].sum())
    return [None if e else k for k, e in zip(keys, empty.tolist(), strict=True)], counts, ids[:total]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text (null: empty), add ``end_id`` and write the ids to files in ascending key order (nulls
    first, equal keys by a hash of their text). Gives the list of files: file, part, seq, n_docs, n_ids.

    Texts are dealt to tasks by ranges of key and hash and sorted there, so a key (or null) with many rows is spread over
    several tasks; only rows that agree in both meet in one. A file's name comes from its task and number and its bytes
    from the texts alone, so a repeated task writes the same files again. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def close(part: int, seq: int, held: list) -> dict:
        keys, counts, ids = [k for h in held for k in h[0]], [n for h in held for n in h[1]], np.concatenate([h[2] for h in held])
        name = f"{part:06d}-{seq:06d}.ids"
        put_file(folder, name, encode_file(keys, counts, ids))
        return {"file": name, "part": part, "seq": seq, "n_docs": len(keys), "n_ids": len(ids)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seq, held, size = tokenizer(tokenizer_path), 0, 0, [], 0
        for b in batches:
            if len(b):
                part = b.column("part")[0].as_py()
            for i in range(0, len(b), 1000):
                some = b.slice(i, 1000)
                ids, counts = known.encode(some.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                counts = counts + 1
                keys = some.column("id").to_pylist()
                at = first = 0
                for j, n in enumerate(np.cumsum(counts).tolist()):
                    if size + n - at >= file_ids or j == len(keys) - 1:
                        held.append((keys[first : j + 1], counts[first : j + 1].tolist(), ids[at:n]))
                        size, at, first = size + n - at, n, j + 1
                    if size >= file_ids:
                        yield pa.RecordBatch.from_pylist([close(part, seq, held)])
                        seq, held, size = seq + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([close(part, seq, held)])

    # The largest 64-bit key is left as it is; nulls come first in Spark's order.
    dealt = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id"), F.xxhash64("text")]
    ordered = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))
    return staged(ordered.mapInArrow(write, "file string, part long, seq long, n_docs long, n_ids long"), "idfiles")


def read_token_files(spark, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, ids (little-endian unsigned 32-bit)."""
    ship_package(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                keys, counts, ids = decode_file(raw)
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                blobs = [memoryview(ids[e - n : e]).cast("B") for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = pd.DataFrame({"file": path.rsplit("/", 1)[1], "doc_id": pd.array(keys, "Int64"), "at": ends - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(x) for x in blobs]})
                yield out.assign(ids=[x.tobytes() for x in blobs]) if with_ids else out

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content") if files.head(1) else spark.createDataFrame([], "path string, content binary")
    rows = content.mapInPandas(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("file", (F.col("own") + F.col("base")).alias("base"))
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op8_token_id_output(spark, sf):
    import public_tokenizers

    folder = shared_folder(spark, "ids")
    files = write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(spark, folder, files)


QUERIES = {"op8_token_id_output": op8_token_id_output}
ORACLES = {}
