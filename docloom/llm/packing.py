"""Best-fit packing of token sequences, with large items matched first."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import fields_of, keep_columns, ship_package, staged
from docloom.llm.tokens import tokenizer

CAPACITY = 2048
SLICES = 64


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where to put items, given only how many there are of each length.

    Lengths above a third of the capacity are matched from the longest down, each with the longest partner that fits,
    two in a sequence at most. Shorter ones, from the longest down, go where they leave the least room. Items of one
    length are placed many at a time, so the work depends on the number of lengths, at most ``capacity``.

    Gives runs (length, first, last + 1, per, sequence, offset): items ``first`` to ``last`` of that length, ``per`` to
    each sequence counted from ``sequence``, side by side from ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = {}  # room left -> [first sequence, sequences]
    sizes: list[int] = []
    next_id = 0

    def put(length: int, n: int, per: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, per, sequence, offset))
        used[length] += n
        left[length] -= n

    def add_room(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append([first, n])

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            partners = [b for b in large[: bisect_left(large, min(a, capacity - a) + 1)] if left[b] > (1 if b == a else 0)]
            b = partners[-1] if partners else 0
            n = left[a] // 2 if b == a else min(left[a], left[b]) if b else left[a]
            put(a, n, 1, next_id, 0)
            if b:
                put(b, n, 1, next_id, a)
            add_room(capacity - a - b, next_id, n)
            next_id += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            i = bisect_left(sizes, a)
            if i < len(sizes):
                room = sizes[i]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sizes[i]
            else:
                room, first, n = capacity, next_id, -(-left[a] // (capacity // a))
                next_id += n
            per = room // a
            whole = min(n, left[a] // per)
            if whole:
                put(a, whole * per, per, first, capacity - room)
                add_room(room - per * a, first, whole)
            if whole < n and left[a]:
                rest = left[a]
                put(a, rest, rest, first + whole, capacity - room)
                add_room(room - rest * a, first + whole, 1)
                whole += 1
            add_room(room, first + whole, n - whole)
    return runs


def pack(items: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; every length must be 1 to ``capacity``.

    The items are counted by length (at most ``capacity`` numbers reach the driver), the counts are packed, and each item
    finds its place by its number among the items of its length. Numbers are given in ``SLICES`` slices of a length, so a
    length with most of the items is still spread. Rows that agree in all of ``order`` may swap places. Input columns
    sequence_id and offset are replaced. An empty table stays empty. ``items`` must be a written table or cheap to redo.
    """
    ship_package(items.sparkSession)
    kept = keep_columns(items, ["sequence_id", "offset"])
    dealt = items.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    counted = dealt.groupBy(F.col(length).alias("length"), "__slice").agg(F.count("*").alias("n"))
    found = counted.collect()  # at most capacity x SLICES rows
    totals: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(found):
        if not 1 <= r["length"] <= capacity:
            raise ValueError(f"length {r['length']} is not in 1 to {capacity}")
        before[r["length"], r["__slice"]] = totals.get(r["length"], 0)
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    runs = sorted(plan_packing(totals, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    starts = np.zeros((capacity + 1, SLICES), np.int64)
    for (n, s), v in before.items():
        starts[n, s] = v
    shared = items.sparkSession.sparkContext.broadcast((table, starts, np.searchsorted(table[:, 0], np.arange(capacity + 2))))
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(length, "__slice").orderBy(*order)) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts, begins = shared.value
        span = np.int64(1) << 40
        keys = table[:, 0] * span + table[:, 1]
        for b in batches:
            n, part, rank = (b.column(c).to_numpy().astype(np.int64) for c in (length, "__slice", "__n"))
            rank = starts[n, part] + rank
            run = table[np.searchsorted(keys, n * span + rank, "right") - 1]
            at = rank - run[:, 1]
            made = [pa.array(run[:, 4] + at // run[:, 3]), pa.array(run[:, 5] + at % run[:, 3] * n)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + made, names=[*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{fields_of(items, kept)}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token ids of each whole text and ``end_id``, cut into pieces of ``capacity`` where there are more; the first piece
    takes the remainder. Columns: key, piece, start, length, ids_crc32 and, if asked for, ids (little-endian
    unsigned 32-bit). A null text counts as empty: one piece with the end id."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for b in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
            ids, counts = known.encode(b.column("text").to_pylist())
            ids, at, rows = ids.astype("<u4"), 0, []
            for k, n in enumerate(counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                first = len(own) % capacity or min(capacity, len(own))
                for piece, end in enumerate(range(first, len(own) + 1, capacity)):
                    start = 0 if not piece else end - capacity
                    raw = own[start:end].tobytes()
                    rows.append((k, piece, start, end - start, zlib.crc32(raw), *([raw] if with_ids else [])))
            owner, *made = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            # The key of a piece is taken from the batch as it is.
            columns = [b.column("id").take(pa.array(owner, pa.int64())), *[pa.array(x, t) for x, t in zip(made, kinds, strict=False)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    made = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )
    return made.withColumnRenamed("id", key)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All texts tokenised, cut and packed: one row per piece with its sequence and place. Pieces are written once
    between the two steps."""
    pieces = staged(token_pieces(docs, path, end_id, key, text, capacity, with_ids), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], "length", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids, one row per sequence (needs ``with_ids``): sequence_id, n_tokens, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def op10_best_fit_packing(spark, sf):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES = {}
