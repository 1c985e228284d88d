"""Operator 11: MinHash near-duplicates with sequential Bayesian verification.

Candidates share a band of MinHash values. Of two candidates the signatures are compared one batch after another: after
n values of which m agree, the similarity has the posterior Beta(m + 1, n - m + 1), and a pair goes as soon as the chance
that it reaches the threshold is below the chosen miss probability. Survivors are verified on their whole shingle sets.

Equal sets are one point. Bands whose members are the same are one bucket. A bucket of more than ``BLOCK`` points is cut
into blocks, of which the first, its hub, meets every one; within a bucket only a forest of the best surviving pairs is
verified. Then, in buckets whose texts verified links have not all connected, every pair of blocks with texts of unlike
components is compared again: first by signatures, which tell the points that have survivors left, then on the sets of
these points, in the task, where a link that joins two components makes the pairs between them needless. So no link
between texts of different components is lost but by a posterior, and no group of copies is turned into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import among, tidy, without, written
from linkgraph.llm.jaccard import Forest, arrow, components, shingles, verify
from linkgraph.llm.omh import mix
from linkgraph.llm.tokens import release

#: Bands and the values in each: a pair of similarity 0.8 shares none with a chance below 10^-4, one of 0.85 below 10^-5.
BANDS, ROWS = 24, 5
#: Values of a signature, 16 bits each, and of a batch.
VALUES, BATCH = 256, 32
#: The chance that a batch's posterior may leave a pair at the threshold.
MISS = 1e-6
#: Points of a block; pairs that are compared at a time; rows that are gathered before buckets are searched.
BLOCK, PAIRS, GATHERED = 512, 20_000, 8_000

CELL = [("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())]


@cache
def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd numbers; the least product of a set with one of them, modulo 2^64, is a MinHash."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def minima(own: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The MinHash values of a set of hashes, a part of the set at a time."""
    by, out = multipliers(n, seed), np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(own), 1024):
        np.minimum(out, np.multiply.outer(by, own[s : s + 1024]).min(1), out=out)
    return out


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of the set, unlike for unlike bands."""
    h = minima(own, BANDS * ROWS, 1).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[:, k])
    return out.view(np.int64).tolist()


def signature(own: np.ndarray) -> bytes:
    return (minima(own, VALUES, 2) >> np.uint64(48)).astype(np.uint16).tobytes()


@cache
def least_matches(num: int, den: int, miss: float = MISS) -> tuple[int, ...]:
    """For each batch's end: the fewest agreements whose posterior leaves the threshold a chance of ``miss`` at least.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is the chance that n + 1 draws of chance t succeed m times at most.
    """
    out, t = [], num / den
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(sigs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that no batch's posterior drops, with their agreements. Sizes alone may rule a pair out."""
    n, least = sizes, least_matches(num, den)
    ok = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    met = np.zeros(len(i), np.int64)
    for k, m in enumerate(least):
        own = slice(k * BATCH, (k + 1) * BATCH)
        met = met + (sigs[i, own] == sigs[j, own]).sum(1)
        ok = met >= m
        i, j, met = i[ok], j[ok], met[ok]
    return i, j, met


class Bucket:
    """Rows of one (cell, i, j), or of many small cells: who is to be compared with whom."""

    def __init__(self, own: dict[str, np.ndarray], starts: np.ndarray):
        self.own, self.starts = own, np.append(starts, len(own["id"]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of unlike labels, up to ``PAIRS`` and one row's at a time: within a block, or between two."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        label, side = self.own["label"], self.own["side"]
        for s, e in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            cross = self.own["i"][s] != self.own["j"][s]
            first = s + int((side[s:e] == 0).sum())  # side 0 stands first
            for row in range(s, first if cross else e):
                there = np.arange(first if cross else row + 1, e)
                there = there[label[there] != label[row]]
                if len(there):
                    held.append((np.full(len(there), row), there))
                    n += len(there)
                if n >= PAIRS:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def searched(members: DataFrame, work: Callable[[Bucket], Iterator[pa.RecordBatch]], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``work`` of the rows of each (cell, i, j); cells follow one another, and only whole ones are worked on."""
    names = ["cell", "i", "j", "side", "id", "n", "label"]

    gathered = GATHERED // 8 if more else GATHERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, gathered):
                part = batch.slice(at, gathered)
                for c in names:
                    held.setdefault(c, []).append(part.column(c).to_numpy())
                for c in ("sig", *more):
                    held.setdefault(c, []).append(np.array(part.column(c).to_pylist() + [None], object)[:-1])
                own = {c: np.concatenate(v) for c, v in held.items()}
                last = np.flatnonzero((own["cell"] != own["cell"][-1]) | (own["i"] != own["i"][-1]) | (own["j"] != own["j"][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut >= gathered // 2:
                    yield from work(bucket({c: v[:cut] for c, v in own.items()}))
                    own = {c: v[cut:] for c, v in own.items()}
                held = {c: [v] for c, v in own.items()}
        if held and len(held["id"][0]):
            yield from work(bucket({c: np.concatenate(v) for c, v in held.items()}))

    def bucket(own: dict[str, np.ndarray]) -> Bucket:
        change = [np.diff(own[c]) != 0 for c in ("cell", "i", "j")]
        return Bucket(own, np.flatnonzero(np.concatenate([[True], change[0] | change[1] | change[2]])))

    columns = [*names, "sig", *more]
    return members.select(*columns).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "id").mapInArrow(tidy(run), schema)


def matrix(sigs: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.tolist()), np.uint16).reshape(len(sigs), VALUES)


def forests(members: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of a forest of the surviving pairs with most agreements; or cell alone, of which pairs were left."""

    def work(rows: Bucket) -> Iterator[pa.RecordBatch]:
        sigs, ids, cells, forest = matrix(rows.own["sig"]), rows.own["id"], rows.own["cell"], Forest(len(rows.own["id"]))
        found: list[tuple[np.ndarray, ...]] = []
        left: set[int] = set()
        for i, j in rows.pairs():
            found.append(survivors(sigs, rows.own["n"], i, j, num, den))
            if sum(len(x[0]) for x in found) >= 25 * PAIRS:
                settle(forest, found, left, cells)
                found = []
        settle(forest, found, left, cells)
        if forest.edges:
            p, q = ids[np.array(forest.edges)].T
            pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0)
            yield arrow(CELL, [pairs[:, 0], pairs[:, 1], pa.nulls(len(pairs), pa.int64())])
        if left:
            yield arrow(CELL, [[None] * len(left), [None] * len(left), sorted(left)])

    def settle(forest: Forest, found: list, left: set[int], cells: np.ndarray) -> None:
        if found:
            i, j, met = (np.concatenate(c) for c in zip(*found, strict=True))
            before = len(forest.edges)
            forest.add(i, j, met)
            taken = Counter(cells[np.array([p for p, _ in forest.edges[before:]], np.int64)].tolist())
            left.update(c for c, n in Counter(cells[i].tolist()).items() if n > taken[c])

    return searched(members, work, "a long, b long, cell long")


def unsettled(members: DataFrame, num: int, den: int) -> DataFrame:
    """cell, id of the points that have a surviving partner of another label."""

    def work(rows: Bucket) -> Iterator[pa.RecordBatch]:
        sigs, open_ = matrix(rows.own["sig"]), np.zeros(len(rows.own["id"]), bool)
        for i, j in rows.pairs():
            p, q, _ = survivors(sigs, rows.own["n"], i, j, num, den)
            open_[p] = open_[q] = True
        if open_.any():
            yield arrow([("cell", pa.int64()), ("id", pa.int64())], [rows.own["cell"][open_], rows.own["id"][open_]])

    return searched(members, work, "cell long, id long").distinct()


def joined(members: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between points of unlike labels, verified on their sets; none between labels that are linked already."""

    def work(rows: Bucket) -> Iterator[pa.RecordBatch]:
        own = rows.own
        sigs, parent = matrix(own["sig"]), {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        links = []
        for i, j in rows.pairs():
            p, q, met = survivors(sigs, own["n"], i, j, num, den)
            for k in np.argsort(-met, kind="stable").tolist():
                x, y = top(int(own["label"][p[k]])), top(int(own["label"][q[k]]))
                if x == y:
                    continue
                a, b = (np.frombuffer(own["set"][r[k]], np.uint64) for r in (p, q))
                same = len(np.intersect1d(a, b, assume_unique=True))
                if den * same >= num * (len(a) + len(b) - same):
                    parent[max(x, y)] = min(x, y)
                    links.append((int(own["id"][p[k]]), int(own["id"][q[k]])))
        if links:
            yield arrow(CELL[:2], [*zip(*links, strict=True)])

    return searched(members, work, "a long, b long", ("set",))


def keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, key (a digest of the set) and cells (a key a band) of every row; the last two are null for an empty set."""
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("cells", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part, out = batch.slice(s, 200), []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    own = shingles(value.as_py(), k)
                    out.append((doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), bands(own)) if len(own) else (doc, 0, None, None))
                yield arrow(kinds, [*zip(*out, strict=True)])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, key binary, cells array<long>")


def points(docs: DataFrame, k: int, with_set: bool) -> DataFrame:
    """id, n, sig and, if asked for, set (its hashes, sorted) of the rows that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = [("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), *[("set", pa.binary())] * with_set]
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                own = [(doc, x) for doc, value in zip(part.column(0).to_pylist(), part.column(1), strict=True) if len(x := shingles(value.as_py(), k))]
                if own:
                    yield arrow(kinds, [*zip(*((doc, len(x), signature(x), *[x.tobytes()] * with_set) for doc, x in own), strict=True)])

    return docs.mapInArrow(tidy(run), f"id long, n long, sig binary{', set binary' * with_set}")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; texts link at ``den * intersection >= num * union``.

    A null or empty text, and one of white space, has no shingle and no link: it is its own component and is kept. Rows
    with a null doc_id get neither links nor a component and are kept. Rows that share a doc_id are one vertex with the
    links of each of their texts. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    keyed = written(keys(rows, k))
    named = keyed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    first = written(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("cells").alias("cells")))  # equal sets have equal bands
    placed = first.select("id", F.explode("cells").alias("cell"))
    entry = written(placed.groupBy("cell").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("sign")).where(F.col("size") > 1))
    one_each = written(entry.groupBy("size", "sign").agg(F.min("cell").alias("cell")))  # buckets with the same members are one
    members = placed.join(one_each.select("cell", "size"), "cell")
    sized = written(members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    sigs = written(points(among(known, F.col("doc_id"), sized.select("id").distinct()), k, False))
    zero = F.lit(0)

    # the hub, block 0 of a large bucket, meets every block
    target = F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("block"))
    hubs = sized.select("cell", zero.alias("i"), F.explode(target).alias("j"), (F.col("block") > 0).cast("int").alias("side"), "id", F.col("id").alias("label"))
    # the hub's rows against block j; within the hub itself i = j = 0
    found = written(forests(hubs.join(sigs, "id"), num, den))
    pairs = written(found.where(F.col("a").isNotNull()).select("a", "b").distinct())
    texts = among(known, F.col("doc_id"), pairs.select(F.explode(F.array("a", "b")).alias("id"))).select(F.col("doc_id").alias("id"), "text")
    links = written(verify(pairs, texts, k, num, den))
    # an id with several texts ties the groups of copies that they stand in
    tied = named.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id")
    ties = named.join(tied, "doc_id", "left_semi").join(first.select("key", "id"), "key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(ties)
    labels = components(links)
    left = found.where(F.col("a").isNull()).select("cell").distinct()
    again = sized.where("blocks = 1").join(left, "cell", "left_semi").unionByName(sized.where("blocks > 1")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = written(joined(settling(again, sigs, known, k, num, den), num, den))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    told = first.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("component_id"))
    out = keyed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(told, "key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def settling(again: DataFrame, sigs: DataFrame, known: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Blocks to be joined on sets: the points of buckets of several labels that have survivors of another label."""
    several = again.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("usual"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("most"))
    mixed = written(again.join(several.where("labels > 1"), "cell").withColumn("strays", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")))
    opened = written(unsettled(dealt(mixed).join(sigs, "id"), num, den))
    rest = written(mixed.join(opened, ["cell", "id"], "left_semi"))
    sets = points(among(known, F.col("doc_id"), rest.select("id").distinct()), k, True)
    return dealt(rest).join(sets, "id")


def dealt(mixed: DataFrame) -> DataFrame:
    """cell, i, j, side, id, label: whole small buckets; of large ones, blocks of the texts outside the label that most have, against all blocks."""
    zero = F.lit(0)
    one = mixed.where("blocks = 1").select("cell", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", "label")
    stray = mixed.where("blocks > 1 and label <> usual").select("cell", F.pmod(F.xxhash64("id"), F.col("strays")).cast("int").alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), zero.alias("side"), "id", "label")
    every = mixed.where("blocks > 1").select("cell", F.explode(F.sequence(zero, F.col("strays") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "label")
    both = stray.unionByName(every).withColumn("j", -1 - F.col("j"))  # never equal to i: always one side against the other
    return one.unionByName(both)


def dedupe(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Rows with a null doc_id stay."""
    gone = join(docs, k, num, den).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, "doc_id", written(gone))
