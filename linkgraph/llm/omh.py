"""Operator 9: Order MinHash fingerprints of whole texts, and of edited texts.

The k-mers of a text (of words; every other character that is no space is a word of its own) are numbered by occurrence,
so repeated ones stay apart. For each of several orders the smallest few numbered k-mers are selected, put back into
text order and hashed as a tuple. Two fingerprints agree in an entry if the same k-mers, in the same order, were
selected, which depends on edit distance and not on the set of words alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import tidy

TOKEN = re.compile(r"[A-Za-z0-9_À-ɏ]+|\S")
#: Words in a k-mer, k-mers in a tuple, entries of a fingerprint.
K, L, ENTRIES = 2, 2, 48
CELLS = 1 << 20
_ODD = np.array([int.from_bytes(hashlib.sha256(b"order %d" % i).digest()[:8], "little") | 1 for i in range(1024)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (constants of a public mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, k: int = K, ell: int = L, entries: int = ENTRIES) -> np.ndarray:
    """32-bit entries; none for a text without words. A text of fewer than ``k`` words is one k-mer."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(t) for t in TOKEN.findall(text)], np.uint64)
    if not len(words):
        return np.zeros(0, np.uint32)
    n = max(1, len(words) - k + 1)
    mers = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        mers += words[j : n + j] * _ODD[1000 + j]
    mers = mix(mers)
    order = np.argsort(mers, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(mers[order]) != 0]))
    numbered = np.empty(n, np.uint64)
    numbered[order] = np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64)
    numbered = mix(mers + numbered * _ODD[1010])
    out = np.zeros(entries, np.uint64)
    step = max(1, CELLS // n)
    for a in range(0, entries, step):
        values = numbered[None] * _ODD[a : min(entries, a + step), None]
        rows = np.arange(len(values))
        picked = []
        for _ in range(min(ell, n)):
            at = values.argmin(1)
            picked.append(at)
            values[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        own = np.zeros(len(rows), np.uint64)
        for at in np.sort(np.stack(picked), 0):
            own = mix(own * _ODD[1020] + mers[at])
        out[a : a + step] = own
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; two texts without words are alike, and unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def chained(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of descending doc_id; each range also gets, marked, the first row of the range after it.

    The ranges' bounds and first ids (a few a partition) are all that reaches the driver. The range after the last is
    the first. Null ids come last; rows of one id follow one another by a hash of their text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        """How many cuts lie above the id."""
        return pd.Series(len(bounds.value) - np.searchsorted(bounds.value, key.to_numpy(), side="right")).astype("int32")

    placed = rows.withColumn("b", bucket(key))
    heads = sorted(placed.select("b", key.alias("key")).groupBy("b").agg(F.max("key").alias("key")).collect())
    before = {h.b: heads[i - 1].b for i, h in enumerate(heads)}
    # a row a range, no more than there are partitions
    ranges = spark.createDataFrame([(h.b, h.key, before[h.b]) for h in heads] or [(0, 0, 0)], "b int, head long, target int")
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead"))
    places = F.when(F.col("head") == key, F.array(own, F.struct(F.col("target").alias("b"), F.lit(1).alias("ahead")))).otherwise(F.array(own))
    dealt = placed.join(F.broadcast(ranges), "b").select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.b", "p.ahead")
    return dealt.repartitionByRange(parts, "b").sortWithinPartitions("b", "ahead", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints as hex, near_edited and near_next of every text.

    The edited text has its last third replaced by the start of the next document in descending doc_id. A null text is
    empty; the only row of a table is its own next document; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # bucket, doc_id, text and fingerprint of the row that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            for doc, text, b, ahead in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ahead and (kept is None or kept[0] != b):
                    continue  # another first row of the same id
                text = text.as_py()
                mark = fingerprint(text)
                if kept is not None:
                    _, own_id, own, own_mark = kept
                    third = len(own) // 3
                    edited = own[: len(own) - third] + text[:third]
                    new = own_mark if edited == own else fingerprint(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark.astype(">u4").tobytes().hex(), new.astype(">u4").tobytes().hex(), likeness(own_mark, new), likeness(own_mark, mark)))
                kept = None if ahead else (b, doc, text, mark)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return chained(docs).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
