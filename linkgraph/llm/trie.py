"""Operator 12: the trie of conversation prefixes.

Every conversation is a chain of digests: that of a prefix is the digest of the one before it and of the prefix's last
turn, so equal prefixes have equal digests and no text is compared. Every prefix is a row; grouped by (depth, digest)
they are the nodes. Only digests and lengths of turns are shuffled, texts are not.

For sums over subtrees each node goes to all its ancestors. The nodes of which one conversation is the smallest member
are the lower end of that conversation's path, so what they add is summed from the deepest one up first, and each prefix
of the path is sent one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import CRC_TABLE, crc32_sql, tidy, written

#: The chain's start, which is the root's digest.
ROOT = bytes(16)
#: Bytes of the text of ids that one row of ends holds at most, but for the last id.
CHUNK = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, own (digest of role and text), chars (code points of the text); null role or text is empty, rows without conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(own, 1, 32)).alias("own"), F.length(text).cast("long").alias("chars"))


def rebuilt(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, place (null for own turns), turn, own, chars, skip.

    A conversation begins with the first h turns of the one that leads its group of ids, h = crc32(conv_id) % ``heads``;
    ``skip`` says how many of its own turns go.
    """
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "own"))
    lead = rows.where(F.col("conv_id") % group == 0).withColumn("place", first).where(F.col("place") < heads)
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    ids = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("lead"))
    lent = ids.join(lead.withColumnRenamed("conv_id", "lead"), "lead").where(F.col("place") <= h).select("conv_id", "place", F.lit(None).cast("long").alias("turn"), "own", "chars")
    return lent.unionByName(rows.select("conv_id", F.lit(None).cast("int").alias("place"), "turn", "own", "chars")).withColumn("skip", h)


def whole(rows: DataFrame) -> DataFrame:
    """Turns of conversations as they are, in the form of ``rebuilt``."""
    return rows.select("conv_id", F.lit(None).cast("int").alias("place"), "turn", "own", "chars", F.lit(0).alias("skip"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (digest), chars (of the last turn), ends, of every prefix, the empty one too.

    The rows of a conversation follow one another in one partition, and only the chain's last digest is held, so a
    conversation of any length takes the same memory.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # the row that waits to be told whether its conversation ends with it
        left = 0
        for batch in batches:
            out = []
            for conv, place, own, chars, skip in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "own", "chars", "skip")), strict=True):
                if at is None or conv != at[0]:
                    if at is not None:
                        out.append((*at, True))
                    at, left = (conv, 0, ROOT, None, 0), skip
                if place is None and left:
                    left -= 1
                    continue
                out.append((*at, False))
                at = (conv, at[1] + 1, hashlib.blake2b(at[2] + own, digest_size=16).digest(), at[2], chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, True), schema, strict=True)], schema=schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_last(), F.col("turn").asc_nulls_first(), "own")
    return dealt.mapInArrow(tidy(chain), "conv_id long, depth long, digest binary, parent binary, chars long, ends boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the decimal conv_ids that end at a node, ascending and joined by commas.

    A node where many conversations end is cut into ranges of ids, which tasks of their own turn to text; the text is
    hashed piece by piece as it comes, so no list of ids is ever held.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, low, held, size = None, None, [], 0
        names, kinds = ["digest", "low", "ids"], [pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for d, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (d != digest or size >= CHUNK):
                    out.append((digest, low, ",".join(held)))
                    held, size = [], 0
                if not held:
                    digest, low = d, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((digest, low, ",".join(held)), kinds, strict=True)], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = None, None
        names, kinds = ["digest", "ends_sha256"], [pa.binary(), pa.string()]
        for batch in batches:
            out = []
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if d != digest:
                    if state:
                        out.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([state.hexdigest()])], names=names)

    ranges = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(tidy(joined), "digest binary, low long, ids string")
    return ranges.repartition("digest").sortWithinPartitions("digest", "low").mapInArrow(tidy(hashed), "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """A row for each distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``n_leaves`` and ``saved_tokens`` are sums over the node's subtree; ``saved_tokens`` counts the code points of a
    node's last text once for each member but one. ``rebuild`` lends each conversation the first turns of the one that
    leads its hundred ids. Turns are in the order of ``turn``, null first; rows of one turn are in the order of their
    digests, each a turn of its own. Rows with a null conv_id belong to no conversation and go, null roles and texts are
    empty, other columns are ignored, and an empty table gives no rows, not even a root.
    """
    rows = turns(conversations)
    rows = written(prefixes(rebuilt(rows) if rebuild else whole(rows)))
    nodes = written(
        rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"))
        .withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    )
    # (what a path's prefix is worth) the nodes that this conversation stands for, summed from the deepest up
    zero = F.lit(0).cast("long")
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), "leaf", "saved")
    path = rows.select("conv_id", "depth", "digest", zero.alias("leaf"), zero.alias("saved")).unionByName(own)
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc(), F.col("digest").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    worth = path.select("digest", F.sum("leaf").over(up).alias("n_leaves"), F.sum("saved").over(up).alias("saved_tokens"), F.count_if(F.col("digest").isNull()).over(up).alias("stands")).where(F.col("digest").isNotNull() & (F.col("stands") > 0))
    nil, none = (F.lit(None).cast(t) for t in ("long", "string"))
    parts = worth.select("digest", nil.alias("conv_id"), nil.alias("depth"), F.lit(None).cast("binary").alias("parent"), nil.alias("n_convs"), zero.alias("n_children"), "n_leaves", "saved_tokens", none.alias("ends_sha256"))
    parts = parts.unionByName(nodes.select("digest", "conv_id", "depth", "parent", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), none.alias("ends_sha256")))
    parts = parts.unionByName(nodes.where("depth > 0").select(F.col("parent").alias("digest"), nil.alias("conv_id"), nil.alias("depth"), F.lit(None).cast("binary").alias("parent"), nil.alias("n_convs"), F.lit(1).cast("long").alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), none.alias("ends_sha256")))
    ended = end_digests(rows.where("ends").select("digest", "conv_id"))
    parts = parts.unionByName(ended.select("digest", nil.alias("conv_id"), nil.alias("depth"), F.lit(None).cast("binary").alias("parent"), nil.alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256"))
    found = written(parts.groupBy("digest").agg(*(F.max(c).alias(c) for c in ("conv_id", "depth", "parent", "n_convs", "ends_sha256")), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))))
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def oracle() -> str:
    """The rebuilt trie in DuckDB's SQL: keys of nodes are the digests of all turns so far, one after the other."""
    return f"""WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, turn, sha256(length(role) || ':' || role || text) AS k, CAST(length(text) AS BIGINT) AS chars FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM own),
ids AS (SELECT c, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM own), crc),
told AS (SELECT ids.c, p, 0 AS later, k, chars FROM ids JOIN placed l ON l.c = ids.c - ids.c % 100 AND l.p <= ids.h UNION ALL SELECT ids.c, p, 1, k, chars FROM ids JOIN placed o ON o.c = ids.c AND o.p > ids.h),
row_of AS (SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER w AS key, chars FROM told WINDOW w AS (PARTITION BY c ORDER BY later, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT c, 0, '', 0 FROM ids),
node AS (SELECT key, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM row_of GROUP BY key),
parented AS (SELECT *, CASE WHEN depth > 0 THEN left(key, CAST(64 * (depth - 1) AS INTEGER)) END AS parent FROM node),
kids AS (SELECT parent, count(*) AS n FROM parented WHERE parent IS NOT NULL GROUP BY parent),
valued AS (SELECT key, depth, (n_convs - 1) * chars AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM parented LEFT JOIN kids ON kids.parent = key),
sums AS (SELECT left(key, CAST(64 * d AS INTEGER)) AS key, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1),
last AS (SELECT c, max_by(key, depth) AS key FROM row_of GROUP BY c),
ended AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM last GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, n_leaves, saved_tokens, coalesce(ends, '{NO_ENDS}') AS ends_sha256
FROM parented n JOIN sums USING (key) LEFT JOIN kids ON kids.parent = n.key LEFT JOIN ended ON ended.key = n.key LEFT JOIN node above ON above.key = n.parent"""
