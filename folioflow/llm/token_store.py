"""Token ids in binary files with random access: directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap
beside it marks the ids that go on, whose next chunks form level 1, and so on. Each bitmap
has a rank directory (set bits before each block of 512), so the place of an id's next chunk
is one rank, and any id is read without decoding its neighbours.

A file, all integers little-endian:

    8 bytes   magic "DACIDS02"
    u64       number of ids, u64 number of documents, u64 number of levels
    per level u64 chunks, u64 offset of chunks, of bitmap, of rank directory
    u64       offset of the document directory, of the doc_ids, of the bitmap of doc_ids that are there
    ...       the sections: chunks (u8), bitmap (bits, lowest first), ranks (u64);
              the document directory: for each document its first id (u64), one more at the end;
              the doc_ids (i64) and a bit for each that is not null

Files hold documents in ascending doc_id, file after file; a file ends with the document by which it reaches
FILE_IDS ids, and a range of doc_ids starts a new one, so a task holds the ids of one file. They are written under a
temporary name and renamed, so a task that runs again replaces its own files with equal bytes.
The manifest, a Parquet table in the same folder (name, documents, ids, start: ids before it), is written when all
files are there. Folder and session are all that :func:`read` needs.

Defined cases: null text is an empty document, which has the end id alone; a null doc_id
sorts first; rows of equal doc_id follow each other by a hash of their text; an empty table gives no files
and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import FIRST, Ranges, fresh_path, gives_back, keeps, release, rows_of, store, whole_text
from folioflow.llm.tokens import encoder

MAGIC = b"DACIDS02"
CHUNK_BITS = 8
BLOCK = 512
END_ID = 1
#: Documents aimed at in a range of doc_ids, which a task writes; and ids at which a file ends.
RANGE_ROWS = 4_000
FILE_IDS = 1 << 22


def encode(ids: np.ndarray, firsts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One file's bytes: all its ids, the first id of each document plus the total, and the documents' own ids."""
    sections, levels, left = [], [], ids.astype(np.uint32, copy=False)
    while True:
        more = (left >> CHUNK_BITS) != 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)))
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate(([np.uint64(0)], np.cumsum(counts, dtype=np.uint64)))
        sections += [(left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        levels.append(len(left))
        if not more.any():
            break
        left = left[more] >> CHUNK_BITS
    there = np.array([d is not None for d in doc_ids], dtype=bool)
    sections += [firsts.astype("<u8").tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.packbits(there, bitorder="little").tobytes()]
    at, places = len(MAGIC) + 24 + 32 * len(levels) + 24, []
    for s in sections:
        places.append(at)
        at += len(s)
    head = [struct.pack("<QQQ", len(ids), len(firsts) - 1, len(levels))]
    head += [struct.pack("<QQQQ", n, *places[3 * k : 3 * k + 3]) for k, n in enumerate(levels)]
    return b"".join([MAGIC, *head, struct.pack("<QQQ", *places[-3:]), *sections])


class Reader:
    """Random access to one file's bytes (a buffer or a memory map)."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n, self.documents, depth = struct.unpack_from("<QQQ", self.data, 8)
        self.levels = []
        for k in range(depth):
            n, chunks, bits, ranks = struct.unpack_from("<QQQQ", self.data, 32 + 32 * k)
            blocks = -(-n // BLOCK)
            self.levels.append(
                (
                    np.frombuffer(self.data, dtype=np.uint8, count=n, offset=chunks),
                    np.frombuffer(self.data, dtype=np.uint8, count=blocks * BLOCK // 8, offset=bits),
                    np.frombuffer(self.data, dtype="<u8", count=blocks + 1, offset=ranks),
                )
            )
        at, own, there = struct.unpack_from("<QQQ", self.data, 32 + 32 * depth)
        self.firsts = np.frombuffer(self.data, dtype="<u8", count=self.documents + 1, offset=at).astype(np.int64)
        bits = np.frombuffer(self.data, dtype=np.uint8, count=(self.documents + 7) // 8, offset=there)
        absent = ~np.unpackbits(bits, count=self.documents, bitorder="little").view(bool)
        self.doc_ids = pa.array(np.frombuffer(self.data, dtype="<i8", count=self.documents, offset=own), pa.int64(), mask=absent)

    def rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before each place of a level's bitmap: one directory entry and at most one block."""
        _, bits, ranks = self.levels[level]
        i = np.asarray(i, dtype=np.int64)
        block = i // BLOCK
        if not len(bits):
            return np.zeros(len(i), dtype=np.int64)
        window = bits.reshape(-1, BLOCK // 8)[np.minimum(block, len(bits) // (BLOCK // 8) - 1)]
        inside = i - block * BLOCK
        whole = np.clip(inside[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)
        masked = window & ((1 << whole) - 1).astype(np.uint8)
        return ranks[block].astype(np.int64) + np.bitwise_count(masked).sum(axis=1, dtype=np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        i = np.asarray(places, dtype=np.int64)
        out, live = np.zeros(len(i), dtype=np.uint32), np.arange(len(i))
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[live] |= chunks[i].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            go = (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            if not go.any():
                break
            i, live = self.rank(level, i[go]), live[go]
        return out

    def run(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids at start .. end: two ranks a level bound where their next chunks lie."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:end].astype(np.uint32)
        if level + 1 < len(self.levels) and end > start:
            low = start >> 3
            more = np.unpackbits(bits[low : (end + 7) >> 3], bitorder="little")[start - 8 * low : end - 8 * low].view(bool)
            a, b = self.rank(level, np.array([start, end]))
            if b > a:
                out[more] |= self.run(int(a), int(b), level + 1) << np.uint32(CHUNK_BITS)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.run(int(self.firsts[k]), int(self.firsts[k + 1]))


@gives_back
@keeps
def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, tie) to the range they belong to and their ids."""
    ids_of, end = encoder(path).all16, np.array([end_id], dtype="<u2").tobytes()
    for batch in rows_of(batches):
        ids = [x + end for x in ids_of(batch.column(1).to_pylist())]
        own = ranges.of(batch.column(0).fill_null(FIRST).to_numpy(), batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["bucket", "doc_id", "ids", "tie"])


_FILE = pa.schema([("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


@gives_back
def _write(batches: Iterator[pa.RecordBatch], path: str, file_ids: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, ids, tie) in order; files of about file_ids ids, each held until it ends."""
    where, base = fs.FileSystem.from_uri(path)
    where.create_dir(base, recursive=True)

    def out(bucket: int, number: int, parts: list[bytes], keys: list) -> pa.RecordBatch:
        lengths = np.fromiter((len(p) // 2 for p in parts), dtype=np.int64, count=len(parts))
        data = encode(np.frombuffer(b"".join(parts), dtype="<u2"), np.concatenate(([0], np.cumsum(lengths))), keys)
        name = f"ids-{bucket:05d}-{number:07d}.dac"
        context = TaskContext.get()
        with where.open_output_stream(temporary := f"{base}/.{name}.{context.taskAttemptId() if context else 0}") as f:
            f.write(data)
        where.move(temporary, f"{base}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], schema=_FILE)

    bucket, number, size, parts, keys = None, 0, 0, [], []
    for batch in batches:
        for b, d, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if parts and (b != bucket or size >= 2 * file_ids):
                yield out(bucket, number, parts, keys)
                number, size, parts, keys = number + 1, 0, [], []
            if b != bucket:
                bucket, number = b, 0
            parts.append(ids)
            keys.append(d)
            size += len(ids)
    if parts:
        yield out(bucket, number, parts, keys)


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> str:
    """Encode every whole text, write the files and their manifest, and return their folder."""
    path = path or fresh_path(docs.sparkSession, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = Ranges(rows, "doc_id", round(docs.count() / RANGE_ROWS))
    ids = rows.mapInArrow(partial(_encoded, path=tokenizer, end_id=end_id, ranges=ranges), "bucket int, doc_id long, ids binary, tie long")
    ids = ids.repartitionById(ranges.n, "bucket").sortWithinPartitions("bucket", "doc_id", "tie")
    files = store(ids.mapInArrow(partial(_write, path=path, file_ids=file_ids), "name string, documents long, ids long"), "token-files")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", before).write.parquet(f"{path}/manifest")  # a row for each file of millions of ids
    release(files)
    return path


@gives_back
def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    where, base = fs.FileSystem.from_uri(path)
    for batch in batches:
        for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with where.open_input_file(f"{base}/{name}") as f:
                reader = Reader(f.read())
            crcs = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in range(reader.documents)]
            yield pa.RecordBatch.from_arrays([reader.doc_ids, pa.array(start + reader.firsts[:-1]), pa.array(np.diff(reader.firsts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the folder's files alone."""
    files = spark.read.parquet(f"{path}/manifest").select("name", "start")
    rows = files.repartition(max(1, min(files.count(), 1 << 16)), "name")  # about a task for each file
    return rows.mapInArrow(partial(_read, path=path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, places: list[int]) -> list[int]:
    """The ids at places of the whole corpus, by the manifest and single ranks; the driver sees the files that hold them."""
    where, base = fs.FileSystem.from_uri(path)
    asked = spark.createDataFrame([(int(p),) for p in places], "place long")
    held = spark.read.parquet(f"{path}/manifest").select("name", "start", (F.col("start") + F.col("ids")).alias("end"))
    found = {r["place"]: r for r in held.join(F.broadcast(asked), (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))).collect()}
    out, readers = [], {}
    for p in places:
        if (name := found[p]["name"]) not in readers:
            with where.open_input_file(f"{base}/{name}") as f:
                readers = {name: Reader(f.read())}
        out.append(int(readers[name].at(np.array([p - found[p]["start"]]))[0]))
    return out
