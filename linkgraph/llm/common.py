"""Helpers that several operators share: the shared scratch folder, written tables and text column checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent (a local session, as in tests) a temporary folder of this machine is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids are screened by a map of so many bits (2 MB whatever the input); an exact join decides where a bit is set.
MAP_BITS = 24


def screened(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """row (a struct of all columns) and maybe: false where ``key`` is surely none of ``ids`` (one column of longs)."""
    number = lambda x: F.pmod(F.xxhash64(x.cast("long")), F.lit(1 << MAP_BITS))
    x = number(F.col(ids.columns[0]))
    bits = ids.groupBy(F.bitmap_bucket_number(x).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("_bits"))  # 513 rows of 4 KB at most
    h = number(key)
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).cast("int").alias("_at"))
    bit = F.expr("shiftright(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int), _at % 8) & 1 = 1")
    return own.join(F.broadcast(bits), "_bucket", "left").select("row", F.coalesce(bit, F.lit(False)).alias("maybe"))


def among(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose key is one of ``ids``, and a few others; no row moves."""
    return screened(rows, key, ids).where("maybe").select("row.*")


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is none of ``ids`` (one column of longs); a null key stays.

    Only rows whose bit of the map is set are joined, so most texts never move, and none is lost however full the map is.
    """
    found = screened(rows, F.col(key), ids)
    drop = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    asked = found.where("maybe").select("row").join(drop, F.col(f"row.`{key}`").cast("long") == F.col("_id"), "left_anti")
    return found.where("not maybe").select("row").unionByName(asked).select("row.*")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back when its task ends: idle workers would keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of the GNU C library
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_rows(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The table that ``work`` makes of whole rows, column by column at its place; any column name will do."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(tidy(work), plain.schema).toDF(*docs.columns)


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds, F.lit(0))


def crc_u32(data) -> int:
    """Of bytes, or of the bytes of a contiguous array."""
    return zlib.crc32(data) & 0xFFFFFFFF


#: A table expression of DuckDB's SQL, which has no crc32: ``t`` holds the checksum's step for each byte.
CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t)"


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of an SQL expression, where ``crc`` of ``CRC_TABLE`` is among the tables."""
    octets = f"list_transform(range(1, length(hex({text})), 2), lambda i: CAST('0x' || substr(hex({text}), CAST(i AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
