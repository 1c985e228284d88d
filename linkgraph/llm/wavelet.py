"""Operator 2: token-id output as one wavelet matrix a shard.

A shard holds the ids of consecutive documents as succinct bit planes. Level ``b`` stores one bit of every id, and ids
are dealt stably to the next level by that bit, so rank on a few planes answers access, counting and occurrence lookup
without unpacking the rest. Every shard is one file (one Parquet file with one row, so Spark's commit protocol makes
the write atomic and any file system will do); inside it the planes are compressed one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import crc_u32, scratch, tidy
from linkgraph.llm.tokens import encoded

MAGIC = b"WMX1"
#: Bits of one block of the rank directory, and ids that are dealt to the next level at a time, for the cache's sake.
BLOCK, PART = 512, 1 << 16
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, shard binary"
#: Ids that a shard gathers before it is closed; the last document of a shard is never cut.
SHARD_TOKENS = 1 << 21


class WaveletMatrix:
    """Bit planes from the highest bit down, the number of zeros of each, and block counts for rank."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, zeros = [], []
        x, y = ids.copy(), np.empty_like(ids)
        for b in range(bits - 1, -1, -1):
            one = x & x.dtype.type(1 << b) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low, high = 0, len(x) - int(np.count_nonzero(one))
            zeros.append(high)
            for a in range(0, len(x), PART):  # places cost far less than a mask where bits are mixed
                own, part = one[a : a + PART], x[a : a + PART]
                at = np.flatnonzero(~own)
                y[low : low + len(at)] = part.take(at)
                low += len(at)
                at = np.flatnonzero(own)
                y[high : high + len(at)] = part.take(at)
                high += len(at)
            x, y = y, x
        return cls(len(ids), planes, zeros)

    @property
    def bits(self) -> int:
        return len(self.planes)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        plane = self.planes[level]
        if level not in self._ranks:
            step = BLOCK // 8
            padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
            padded[: len(plane)] = plane
            counts = np.bitwise_count(padded).reshape(-1, step).sum(1, dtype=np.int64)
            self._ranks[level] = np.concatenate([[0], np.cumsum(counts)])
        block = i // BLOCK
        rest = np.unpackbits(plane[block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(self._ranks[level][block]) + int(rest.sum())

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one = self.planes[level][i >> 3] >> (i & 7) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if one else i - ones
            value = value << 1 | int(one)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self.rank1(level, start), self.rank1(level, end)
            one = token >> (self.bits - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` stands in ``start <= position < end``."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select1(self, level: int, k: int, bit: int) -> int:
        """Position of the ``k``-th (from 0) bit of that value in a level."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self.select1(level, at - self.zeros[level] if one else at, one)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending, by walking its range up through the planes."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for level in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            one = token >> (self.bits - 1 - level) & 1
            plane = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            at = np.flatnonzero(plane == one)[at - self.zeros[level] if one else at]
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x, y = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            low, high, bit = 0, self.zeros[level], kind(1 << (self.bits - 1 - level))
            for a in range(0, self.n, PART):
                own, part = one[a : a + PART], y[a : a + PART]
                at = np.flatnonzero(~own)
                part[at] = x[low : low + len(at)]
                low += len(at)
                at = np.flatnonzero(own)
                part[at] = x[high : high + len(at)] | bit
                high += len(at)
            x, y = y, x
        return x


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard file: header, document table, zero counts, then every plane compressed by itself."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    matrix = WaveletMatrix.build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    table = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "<u1"), np.array(lengths, "<i8")]
    parts = [squeeze(b"".join(x.tobytes() for x in table)), np.array(matrix.zeros, "<i8").tobytes(), *(squeeze(p.tobytes()) for p in matrix.planes)]
    return MAGIC + struct.pack("<qqi", len(doc_ids), len(ids), bits) + b"".join(struct.pack("<q", len(p)) + p for p in parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents, their lengths and the wavelet matrix of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    n_docs, n, bits = struct.unpack_from("<qqi", data, 4)
    at, parts = 24, []
    while at < len(data):
        (size,) = struct.unpack_from("<q", data, at)
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    expand = zstandard.ZstdDecompressor().decompress
    table = expand(parts[0])
    null = np.frombuffer(table, "<u1", n_docs, 8 * n_docs)
    doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(table, "<i8", n_docs), null, strict=True)]
    planes = [np.frombuffer(expand(p), np.uint8) for p in parts[2:]] if n else [np.zeros(0, np.uint8)] * bits
    return doc_ids, np.frombuffer(table, "<i8", n_docs, 9 * n_docs), WaveletMatrix(n, planes, np.frombuffer(parts[1], "<i8").tolist())


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text and writes the shards in ascending ``doc_id`` order.

    A null text counts as empty and yields the end id alone; a null ``doc_id`` comes first; rows that share a
    ``doc_id`` follow one another by text hash. Other columns are ignored. An empty table writes no shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, data, total = [], [], [], 0

        def shard():
            blob = pack(ids, sizes, np.concatenate(data))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id), strict=True):
                ids.append(doc), sizes.append(len(got)), data.append(got)
                total += len(got)
                if total >= shard_tokens:
                    yield shard()
                    ids, sizes, data, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    dealt.mapInArrow(tidy(encode), SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the shard it stands in.

    ``start`` adds three sums: ids before the document in its shard, before the shard in its range partition, and in
    earlier range partitions. Only the last is one small list, with a row for each partition that wrote.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                docs, sizes, matrix = unpack(blob)
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(sizes)
                starts = ends - sizes
                crcs = [crc_u32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array([seq] * len(docs), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    docs = shards.select("part", "seq", "shard").mapInArrow(tidy(decode), "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", F.col("n_tokens").alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size")).select("part", before(Window.orderBy("part")).alias("part_start"))
    local = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("shard_start"))
    base = local.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base"))
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", F.concat_ws("-", "part", "seq").alias("shard"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of one id in all shards: part, seq, position in the shard. Reads the planes, decodes nothing."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                at = unpack(blob)[2].occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part), pa.int32()), pa.array(np.full(len(at), seq), pa.int32()), pa.array(at, pa.int64())], names=["part", "seq", "position"])

    return spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "seq", "shard").mapInArrow(tidy(look), "part int, seq int, position long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the shards to the shared folder and returns what the files say of each document."""
    path = scratch(docs.sparkSession)
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(docs.sparkSession, path)
