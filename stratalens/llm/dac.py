"""Directly addressable codes for token ids, in files that give any token without decoding a block.

An id is cut into chunks of ``bits`` bits, least significant first.  Level j holds chunk j of every id
that reaches it, and a bitmap that says whether the id goes on; a rank directory (set bits before each
512) turns a position of level j into one of level j+1 in constant time.

A shard is, little-endian: ``DACS``, its length in bytes, partition, number in it, documents, ids, chunk
bits, levels (8 x u64 after the magic and 4 bytes of padding); document ids (i64), a validity byte each,
document offsets (u64, one more than documents); then per level its length (u64), chunks (u8 or u16),
bitmap (u64 words) and directory (u64), each padded to 8 bytes.  A file is a sequence of shards, each
followed by one line feed, the record end of Spark's text sink, which writes the bytes to any file system.
A shard ends with the document that fills it, and a file with its ``FILE_SHARDS``-th shard, so files stay
small whatever a partition holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import in_key_order
from .runtime import materialise, new_path, ship_package
from .tokens import encode_in_blocks, settle

_HEAD = struct.Struct("<4s4x7Q")
_MAGIC = b"DACS"
_SUPER = 512
#: Shards of one file at most, and ids of a shard that are read back by address as well.
FILE_SHARDS, PROBES = 8, 64


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


class DacArray:
    """An immutable array of unsigned ids in direct addressable codes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int) -> None:
        self.levels, self.bits = levels, bits

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @classmethod
    def encode(cls, ids: np.ndarray, bits: int = 8) -> "DacArray":
        if not 1 <= bits <= 16:
            raise ValueError("bits must be from 1 to 16")
        kind, levels, rest = (np.uint8 if bits <= 8 else np.uint16), [], np.asarray(ids, dtype=np.uint64)
        while len(rest):
            on = (rest >> np.uint64(bits)) > 0
            words = np.zeros(-(-len(rest) // 64) * 8, dtype=np.uint8)
            packed = np.packbits(on, bitorder="little")
            words[: len(packed)] = packed
            bitmap = words.view("<u8")
            levels.append(((rest & np.uint64((1 << bits) - 1)).astype(kind), bitmap, cls._directory(bitmap)))
            rest = rest[on] >> np.uint64(bits)
        return cls(levels, bits)

    @staticmethod
    def _directory(bitmap: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(bitmap).astype(np.uint64)
        per = _SUPER // 64
        sums = np.add.reduceat(ones, np.arange(0, len(ones), per)) if len(ones) else ones
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(sums, dtype=np.uint64)])

    def _rank(self, level: int, i: int) -> int:
        _, bitmap, directory = self.levels[level]
        word, start = i // 64, i // _SUPER * (_SUPER // 64)
        n = int(directory[i // _SUPER]) + int(np.bitwise_count(bitmap[start:word]).sum())
        return n + int(int(bitmap[word]) & ((1 << (i % 64)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        """Id number ``i``: at most one rank look-up per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = level = 0
        while True:
            codes, bitmap, _ = self.levels[level]
            value |= int(codes[i]) << shift
            if not int(bitmap[i // 64]) >> (i % 64) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + self.bits

    def decode(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, dtype=np.uint32)
        for codes, bitmap, _ in reversed(self.levels):
            on = np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(codes)].astype(bool)
            out = codes.astype(np.uint32)
            out[on] |= value << np.uint32(self.bits)
            value = out
        return value

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<Q", len(c)) + _padded(c) + _padded(b) + _padded(d) for c, b, d in self.levels)

    @classmethod
    def from_buffer(cls, data: memoryview, n_levels: int, bits: int) -> "DacArray":
        at, levels, kind = 0, [], np.dtype("u1" if bits <= 8 else "<u2")

        def take(t: np.dtype, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, dtype=t, count=n, offset=at)
            at += -(-a.nbytes // 8) * 8
            return a

        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            words = -(-n // 64)
            levels.append((take(kind, n), take(np.dtype("<u8"), words), take(np.dtype("<u8"), -(-words // (_SUPER // 64)) + 1)))
        return cls(levels, bits)


class Shard:
    """A run of documents with their ids."""

    def __init__(self, doc_ids: list[int | None], offsets: np.ndarray, array: DacArray, part: int = 0, number: int = 0) -> None:
        self.doc_ids, self.offsets, self.array, self.part, self.number = doc_ids, offsets, array, part, number

    def to_bytes(self) -> bytes:
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        valid = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        body = _padded(ids) + _padded(valid) + _padded(self.offsets.astype("<u8")) + self.array.to_bytes()
        return _HEAD.pack(_MAGIC, _HEAD.size + len(body), self.part, self.number, len(ids), len(self.array), self.array.bits, len(self.array.levels)) + body

    @classmethod
    def read_all(cls, data: bytes) -> Iterator["Shard"]:
        view, at = memoryview(data), 0
        while at < len(data):
            magic, size, part, number, n, n_ids, bits, n_levels = _HEAD.unpack_from(view, at)
            if magic != _MAGIC or at + size > len(data):
                raise ValueError(f"no shard at byte {at}")
            body = view[at + _HEAD.size : at + size]
            ids = np.frombuffer(body, "<i8", n)
            valid = np.frombuffer(body, "u1", n, 8 * n)
            base = 8 * n + -(-n // 8) * 8
            offsets = np.frombuffer(body, "<u8", n + 1, base)
            array = DacArray.from_buffer(body[base + 8 * (n + 1) :], n_levels, bits)
            if len(array) != n_ids:
                raise ValueError(f"shard at byte {at} holds {len(array)} ids, not {n_ids}")
            yield cls([int(d) if v else None for d, v in zip(ids, valid, strict=True)], offsets, array, part, number)
            at += size + 1

    def tokens(self, k: int) -> np.ndarray:
        """The ids of document number ``k``, by random access."""
        return np.array([self.array[i] for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))], dtype=np.uint32)

    def decoded(self) -> np.ndarray:
        """All ids; ids evenly spread over the shard are also read by address, and must agree."""
        ids = self.array.decode()
        for i in np.unique(np.linspace(0, len(ids) - 1, PROBES).astype(np.int64)).tolist() if len(ids) else ():
            if self.array[i] != ids[i]:
                raise ValueError(f"id {i} of shard {self.number} in partition {self.part} is {self.array[i]} by address, {ids[i]} in sequence")
        return ids


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, bits: int = 8, shard_ids: int = 2_000_000) -> None:
    """Encode every whole text (null: empty) in ascending ``doc_id`` order into shard files under ``path``."""
    ship_package(docs.sparkSession)
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs_in, blobs, size = [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal docs_in, blobs, size, number
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.uint64)
            s = Shard(docs_in, offsets, DacArray.encode(np.frombuffer(b"".join(blobs), "<u4"), bits), part, number)
            docs_in, blobs, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([s.to_bytes()], pa.binary())], names=["value"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encode_in_blocks(b.column(1).to_pylist(), tokenizer_path), strict=True):
                docs_in.append(doc)
                blobs.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield shard()
        if docs_in:
            yield shard()
        settle()

    blobs = in_key_order(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "value binary")
    blobs.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SHARDS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and ids_crc32 (unsigned, of little-endian u32)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for s in Shard.read_all(data):
                    ids, at = s.decoded().astype("<u4"), s.offsets.astype(np.int64)
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n = len(crc)
                    cols = (pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([s.part] * n, pa.int64()), pa.array([s.number] * n, pa.int64()))
                    yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "at", "n_tokens", "ids_crc32", "part", "number"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialise(files.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, part long, number long"), "token-rows")
    sizes = rows.groupBy("part", "number").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", "number", inside.alias("inside")).join(parts.select("part", earlier.alias("earlier")), "part").select("part", "number", (F.col("inside") + F.col("earlier")).alias("base"))
    return rows.join(bases, ["part", "number"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, bits: int = 8) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back.

    Repeated rows and ids are kept, a null ``doc_id`` comes first, an empty table gives no rows, and a
    null or empty text holds the end id alone.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id, bits)
    return read_token_files(docs.sparkSession, path)
