"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole records, and a seek table in a skippable frame at
its end, so any reader that knows the format can go to a frame. An index maps record ids to bundle, frame and the
record's place in the decompressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import file_size, make_folder, put_file, read_range, salted_lookup, shared_folder, ship_package, staged

FRAME_BYTES = 1 << 20  # records of a frame before compression, unless one record has more
BUNDLE_BYTES = 32 << 20  # frames of a bundle before compression
LEAST_REVISIT = 1000  # smaller payloads are always stored
LEVEL = 3
# Fixed values of the seekable format: skippable frame magic, seek table footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"  # the table has no fetch time


def warc_record(kind: str, record_id: str, target: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record; a revisit names the record it refers to and stores no payload, but its digest and length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if target is not None:
        head.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and body of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield at, fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed bytes, size before) and their seek table."""
    entries = b"".join(struct.pack("<II", len(f), n) for f, n in frames)
    table = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join([*(f for f, _ in frames), struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    at, out = 0, []
    for k in range(n):
        size, _ = struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - k))
        out.append((at, size))
        at += size
    return out


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with ``__refers``: the largest key among rows with an equal payload of at least 1000 bytes, where it is another.

    Payloads are compared by SHA-1 and length. Only groups of two or more are looked up, and their rows are dealt to many
    tasks, so one payload may be that of most rows."""
    raw = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    known = pages.withColumn("__digest", F.sha1(raw)).withColumn("__size", F.octet_length(raw))
    groups = known.where(F.col("__size") >= LEAST_REVISIT).groupBy("__digest", "__size")
    repeated = groups.agg(F.count("*").alias("__n"), F.max(key).alias("__last")).where("__n > 1 and __last is not null").drop("__n")
    joined = salted_lookup(known, repeated, ["__digest", "__size"], [key], how="left")
    return joined.withColumn("__refers", F.when(~F.col("__last").eqNullSafe(F.col(key)), F.col("__last"))).drop("__digest", "__size", "__last")


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", target: str = "url") -> DataFrame:
    """Write one record per row and give the index: record_id, key, bundle, frame, offset, length.

    The payload is the UTF-8 text (null: empty). Of equal payloads of at least 1000 bytes, the row with the largest key
    (all rows that hold it) is a response and the others revisit it; a null key never answers for others and, in a
    group without any key, all are responses. Rows with equal keys get records of the same id. An empty table writes
    nothing. Bundles are cut within a task and named after it, so a repeated task writes the same file again.
    """
    import zstandard

    ship_package(pages.sparkSession)
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        part = seq = size = held = 0
        frames: list[tuple[bytes, int]] = []
        records: list[bytes] = []
        index: list[tuple] = []

        def end_frame() -> None:
            nonlocal size, held
            if records:
                data = b"".join(records)
                frames.append((packer.compress(data), len(data)))
                held, size = held + len(data), 0
                records.clear()

        def end_bundle() -> pa.RecordBatch:
            nonlocal seq, held
            end_frame()
            put_file(folder, f"{part:06d}-{seq:06d}.warc.zst", seal(frames))
            out = _batch(index, INDEX)
            seq, held = seq + 1, 0
            frames.clear()
            index.clear()
            return out

        for b in batches:
            for own, url, text, refers, part in zip(*(b.column(c).to_pylist() for c in ("key", "url", "html", "refers", "part")), strict=True):
                body = (text or "").encode("utf-8", "surrogatepass")
                other = None if refers is None else f"urn:page:{refers}"
                record = warc_record("revisit" if other else "response", f"urn:page:{own}", url, body, other)
                index.append((f"urn:page:{own}", own, f"{part:06d}-{seq:06d}.warc.zst", len(frames), size, len(record)))
                records.append(record)
                size += len(record)
                if size >= FRAME_BYTES:
                    end_frame()
                if held >= BUNDLE_BYTES:
                    yield end_bundle()
        if frames or records:
            yield end_bundle()

    url = F.col(target) if target in pages.columns else F.lit(None).cast("string")
    # The order within a task is fixed, so that a repeated task cuts the same bundles.
    rows = mark_revisits(pages, key, payload).select(F.col(key).cast("long").alias("key"), url.alias("url"), F.col(payload).alias("html"), F.col("__refers").cast("long").alias("refers"))
    ordered = rows.withColumn("part", F.spark_partition_id()).sortWithinPartitions("key", "url", F.xxhash64("html"))
    return staged(ordered.mapInArrow(write, "record_id string, key long, bundle string, frame long, offset long, length long"), "warcindex")


def _row(bundle: str, frame: int, at: int, fields: dict[str, str], body: bytes) -> tuple:
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x.strip("<>").rpartition(":")[2])
    return (
        number(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, kind, number(fields.get("WARC-Refers-To")),
        fields.get("WARC-Target-URI"), bundle, frame, at, body if kind == "response" else None,
    )


INDEX = pa.schema([("record_id", pa.string()), ("key", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("target", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("payload", pa.binary()),
    ]
)
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, bundle string, frame long, offset long, payload binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow columns, so that numbers beside nulls stay as they are. Fields beyond the schema are left out."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_bundles(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of all bundles; every response is checked against its digest. Payloads of revisits are null."""
    import zstandard

    ship_package(spark)

    schema = RECORDS if with_payload else pa.schema(list(RECORDS)[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                raw, name = content.as_py(), path.as_py().rsplit("/", 1)[1]
                for k, (start, size) in enumerate(seek_table(raw)):
                    data = opener.decompress(raw[start : start + size])
                    yield _batch([_row(name, k, *r) for r in parse_records(data)], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(read, SCHEMA if with_payload else SCHEMA.replace(", payload binary", ""))


def fetch_records(folder: str, wanted: DataFrame) -> DataFrame:
    """The records of some rows of the index. Only the seek table and the frames that hold them are read from each bundle;
    rows of one bundle are read together."""
    import zstandard

    spark = wanted.sparkSession
    ship_package(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, bundle, frame, table, data = zstandard.ZstdDecompressor(), None, None, [], b""
        for b in batches:
            rows = []
            for name, number, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if name != bundle:
                    table, bundle, frame = seek_table(_tail(folder, name)), name, None
                if number != frame:
                    frame = number
                    data = opener.decompress(read_range(folder, bundle, *table[frame]))
                (_, fields, body) = next(parse_records(data[offset : offset + length]))
                rows.append(_row(bundle, frame, offset, fields, body))
            yield _batch(rows, RECORDS)

    return wanted.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(fetch, SCHEMA)


def _tail(folder: str, name: str) -> bytes:
    """The seek table's bytes: the footer first, then as much as it names."""
    size = file_size(folder, name)
    n = struct.unpack("<IBI", read_range(folder, name, size - 9, 9))[0]
    return read_range(folder, name, size - 9 - 8 * n, 9 + 8 * n)


def op2_warc_bundles(spark, sf):
    folder = shared_folder(spark, "warc")
    write_bundles(spark.read.parquet(f"{sf}/pages.parquet"), folder)
    return read_bundles(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as last from d)
select page_id, payload_bytes, payload_digest, case when last = page_id then 'response' else 'revisit' end as record_type,
  case when last <> page_id then last end as refers_to from r
"""


QUERIES = {"op2_warc_bundles": op2_warc_bundles}
ORACLES = {"op2_warc_bundles": ORACLE}
