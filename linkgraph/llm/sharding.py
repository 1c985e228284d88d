"""Operator 4: sharding by extendible hashing, with DataFrame and SQL functions only.

The directory is indexed by the leading bits of a key hash. A shard is a (depth, prefix) pair: the shortest prefix
whose rows fit the byte limit, so only oversized shards are split on another bit. Sizes are summed once at a fine
prefix, and the sums of all shorter prefixes follow from that small table, not from the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import written

#: Bits of the key hash, and bits that a prefix which is still too large is refined by at once.
HASH_BITS, MORE_BITS = 60, 8
LIMIT_BYTES = 1 << 20


def key_hash(*cols: str) -> Column:
    """The first 60 bits of md5 over the key columns as text; nulls count as empty."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", HASH_BITS - bits) if bits else F.lit(0).cast("long")


def directory(rows: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """leaf (prefix of ``bits`` bits) -> depth, prefix and bytes of its shard; depth is null if the leaf is too large."""
    leaves = rows.groupBy(prefix(bits).alias("leaf")).agg(F.sum("bytes").alias("bytes"))
    levels = leaves.select("leaf", "bytes", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {bits} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    fitting = levels.join(sums.where(F.col("shard_bytes") <= limit), ["depth", "prefix"]).groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
    return leaves.select("leaf").join(fitting, "leaf", "left").select("leaf", "s.*")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, keys: tuple[str, ...] = ("doc_id",), weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The key columns, those of ``carry``, n_bytes, depth, shard (prefix bits as text), page and shard_bytes of every row.

    No shard holds more than ``limit`` bytes, except one row that alone is larger: it gets a shard of its own. Rows of
    one key value cannot be told apart by its hash; if they are too large together, they go on overflow pages of that
    shard (page 1 and up; 0 elsewhere). A null text weighs nothing; an empty table gives no rows.
    """
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if weight is None else weight
    given, keys = keys, (*keys, *carry)
    rows = written(docs.select(*keys, key_hash(*given).alias("h"), weight.alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")))
    single = rows.where(F.col("bytes") > limit)
    left = rows.where(F.col("bytes") <= limit)
    total = left.agg(F.sum("bytes")).first()[0] or 0
    low, bits = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    out = [single.select(*keys, F.col("bytes").alias("n_bytes"), F.lit(HASH_BITS).alias("depth"), "h", F.concat(F.lit(1).cast("long") + F.col("nth"), F.lit("")).alias("page"), F.col("bytes").alias("shard_bytes"))]
    while True:
        found = written(directory(left, low, bits, limit))
        placed = left.withColumn("leaf", prefix(bits)).join(found.where(F.col("depth").isNotNull()), "leaf")
        out.append(placed.select(*keys, F.col("bytes").alias("n_bytes"), "depth", "h", F.lit("0").alias("page"), "shard_bytes"))
        large = found.where(F.col("depth").isNull()).select("leaf")
        if large.isEmpty():
            break
        left = left.withColumn("leaf", prefix(bits)).join(large, "leaf", "left_semi").drop("leaf")
        if bits == HASH_BITS:
            out.append(overflow(left, keys, limit))
            break
        low, bits = bits + 1, min(HASH_BITS, bits + MORE_BITS)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    bits_text = F.expr(f"if(depth = 0, '', lpad(conv(shiftrightunsigned(h, {HASH_BITS} - depth), 10, 2), depth, '0'))")
    return rows.select(*keys, "n_bytes", F.col("depth").cast("int").alias("depth"), bits_text.alias("shard"), F.col("page").cast("long").alias("page"), "shard_bytes")


def overflow(rows: DataFrame, keys: tuple[str, ...], limit: int) -> DataFrame:
    """Pages for rows of one hash value: bytes before each row, by task and then within it, cut at the room of a page.

    A row of over half the limit gets a page of its own. The others are at most ``top`` bytes each, and a page takes
    the rows that begin within ``limit - top`` bytes of its start, so no page exceeds the limit.
    """
    half = limit // 2
    alone, small = rows.where(F.col("bytes") > half), rows.where(F.col("bytes") <= half)
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = small.groupBy("h", "part").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("top"))
    parts = parts.select("h", "part", before(Window.partitionBy("h").orderBy("part")).alias("start"), F.max("top").over(Window.partitionBy("h")).alias("top"))
    within = small.select("*", before(Window.partitionBy("h", "part").orderBy("nth")).alias("at"))
    paged = within.join(parts, ["h", "part"]).withColumn("page", F.expr(f"2 * ((start + at) div ({limit} - top)) + 1"))
    both = paged.select(*keys, "h", "bytes", "page").unionByName(alone.select(*keys, "h", "bytes", (2 * F.col("nth") + 2).alias("page")))
    sizes = both.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return both.join(sizes, ["h", "page"]).select(*keys, F.col("bytes").alias("n_bytes"), F.lit(HASH_BITS).alias("depth"), "h", F.col("page").cast("string").alias("page"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key: str = "doc_id") -> None:
    """Writes each shard as a folder ``shard=.../page=...``; the rows of a shard meet in one task, so in one file.

    If the table has columns of these names, they stay, and the folders get an underscore before theirs. A null key is
    a key like any other; an empty table writes no shard.
    """
    folders = [f"_{x}" if {"shard", "page"} & set(docs.columns) else x for x in ("shard", "page")]
    row = docs.select(F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("weight"))
    placed = shard(row, limit, ("key",), F.col("weight"), carry=("row",))  # whole rows, so that each is written once
    placed.select("row.*", *(F.col(x).alias(y) for x, y in zip(("shard", "page"), folders, strict=True))).repartition(*folders).write.partitionBy(*folders).parquet(path)


def oracle(limit: int = LIMIT_BYTES) -> str:
    """DuckDB's SQL: each document tries all depths and takes the first whose prefix fits (all texts below the limit)."""
    return f"""
WITH r AS (SELECT doc_id, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
p AS (SELECT r.*, d.depth, h >> ({HASH_BITS} - d.depth) AS prefix FROM r, (SELECT unnest(range(0, 25)) AS depth) d),
s AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM p GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
f AS (SELECT p.*, s.shard_bytes FROM p JOIN s USING (depth, prefix) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) = 1)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM f"""
