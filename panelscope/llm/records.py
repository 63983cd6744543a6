"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file is records end to end. A record is framed as

    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload |
    u32 masked crc32 of the payload | one byte 0x0A

all little-endian, and its payload is ``i32 length of the id (-1: null) | the id as UTF-8
text | u16 ids...``. A masked checksum is the checksum rotated right by 15 bits plus a
constant, so that a checksum of data that holds checksums stays telling. Files are written
by Spark's own text writer (a record is one "line"), so they need no shared local folder,
and a lost task leaves nothing behind; they are read by Spark's binary-file reader.

Documents lie in ascending order of their ids across the files. A first pass over ids and
text sizes sums sizes in that order and cuts it into files of about ``FILE_TEXT_BYTES`` of
text; texts are then encoded where they are read, and only their ids move to the files.

A null or empty text is a record with the end id alone. Null ids come first; rows with
one id lie in the order of a hash of their texts; rows alike in both are alike as records
and may be spread over several files. Ids may be numbers or texts. An empty table gives no
records.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm._common import discard, global_offsets, materialize, new_path, table
from panelscope.llm._tokenize import encoded

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Text bytes that go into one file (or one longer text); a file is read whole by one task.
FILE_TEXT_BYTES = 32 << 20
_MASK_DELTA = 0xA282EAD8


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def masked(data: bytes) -> int:
    c = zlib.crc32(data) & 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data):
    """(offset, payload) of every record of a file; an error if a checksum is wrong."""
    at, view = 0, memoryview(data)
    while at < len(view):
        head = view[at : at + 8]
        (n,) = struct.unpack("<Q", head)
        payload = view[at + 12 : at + 12 + n]
        sums = struct.unpack("<I", view[at + 8 : at + 12]) + struct.unpack("<I", view[at + 12 + n : at + 16 + n])
        if sums != (masked(head), masked(payload)):
            raise ValueError(f"a record's checksum is wrong at byte {at}")
        yield at, payload
        at += 17 + n


def pack(doc_id: str | None, ids: bytes) -> bytes:
    name = b"" if doc_id is None else doc_id.encode()
    return b"".join((struct.pack("<i", -1 if doc_id is None else len(name)), name, ids))


def unpack(payload) -> tuple[str | None, np.ndarray]:
    (n,) = struct.unpack("<i", payload[:4])
    return (None if n < 0 else bytes(payload[4 : 4 + n]).decode()), np.frombuffer(bytes(payload[4 + max(n, 0) :]), "<u2")


def _place(doc_id, h: int) -> tuple:
    """Where a row lies in the order of the records."""
    return (doc_id is not None, 0 if doc_id is None else doc_id, h)


def borders(keys: DataFrame, file_text_bytes: int) -> list[tuple]:
    """The first place of every file but the first: one entry per file, whatever the rows."""
    placed, _ = global_offsets(keys, ["doc_id", "h"], "size", "at", "sizes")
    files = placed.groupBy(F.expr(f"at div {file_text_bytes}").alias("file")).agg(F.min(F.struct("doc_id", "h")).alias("first"))
    found = sorted(_place(*r["first"]) for r in files.collect())
    discard(placed)
    return found[1:]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, file_text_bytes: int = FILE_TEXT_BYTES) -> None:
    """Write the records of ``docs`` (doc_id, text) under ``path``; ``vocabulary``: a tokenizer's file."""
    h = F.xxhash64("text").alias("h")
    first = borders(docs.select("doc_id", h, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), file_text_bytes)
    held = docs.sparkSession.sparkContext.broadcast(first)  # one entry per file

    def file_of(batch, ids, n):
        of, out = held.value, []
        for d, x, uid in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("uid").to_pylist(), strict=True):
            lo, hi = bisect_left(of, _place(d, x)), bisect_right(of, _place(d, x))
            out.append(lo + uid % (hi - lo + 1))
        return [pa.array(out, pa.int32())]

    def run(batches):
        for b in batches:
            rows = zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([frame(pack(i, x))[:-1] for i, x in rows], pa.binary())], names=["r"])

    rows = docs.select("doc_id", h, F.monotonically_increasing_id().alias("uid"), "text")
    placed = encoded(rows, vocabulary, end_id, file_of, "file int")
    ordered = placed.repartitionById(len(first) + 1, "file").sortWithinPartitions("doc_id", "h")
    records = ordered.select(F.col("doc_id").cast("string").alias("id"), "ids").mapInArrow(run, "r binary")
    records.select(F.col("r").cast("string")).write.options(lineSep="\n", maxRecordsPerFile=0).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the files alone: part (the file's number), record, offset,
    length, doc_id (as text), n_tokens, ids_crc32 (of the ids as 32-bit numbers), before (the
    ids before it in its file). Every checksum is verified on the way."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, before, rows = int(name.rsplit("/", 1)[1].split("-")[1]), 0, []
                for k, (at, payload) in enumerate(frames(content.as_buffer())):
                    doc_id, ids = unpack(payload)
                    rows.append((part, k, at, len(payload) + 17, doc_id, len(ids), zlib.crc32(ids.astype("<u4")), before))
                    before += len(ids)
                    if len(rows) == 20_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["part", "record", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, "part int, record long, offset long, length long, doc_id string, n_tokens long, ids_crc32 long, before long")


def write_and_index(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """The records' path, and the written index with each record's ``start`` in the whole."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    write(docs, path, vocabulary, end_id)
    index = read_index(spark, path)
    index = materialize(index.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "index")
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, total = [], 0
    for part, n in totals:  # one row per file
        base.append((part, total))
        total += n
    starts = spark.createDataFrame(base, "part int, _base long")
    return path, index.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("_base")).drop("_base", "before")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = write_and_index(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(VOCABULARY))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
