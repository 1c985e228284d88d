"""Operator 3: n-gram Jaccard join by a count-vector R-tree.

The shingles of a text are hashed into groups, and its group counts are a point. The sum of coordinate minima of two
points bounds their overlap from above. Groups are nested: a coarse point of ``DIMS`` groups is a fold of a finer one,
which has about as many groups as the text has shingles, so the bound of the finer points is close to the overlap.

The tree's root has one entry for each shingle that can be among the rarest few of a text: two linked texts share such a
shingle, since more than the rest would have to be missing otherwise. Below an entry stand nodes, leaves and points in
the order of sizes; nodes and leaves carry the maxima of their coarse counts, and only those are entered whose bound
reaches the threshold. Surviving pairs are verified on the whole shingle sets.

Equal sets are one point. Pairs are taken in two rounds: first, in each entry, a forest over the surviving pairs with
the best bounds; then, in entries where pairs were left over, those among texts which verified links have not connected:
points with such a partner are told first, and their sets are compared in the task that holds the entry, where a link
makes the other pairs of its two components needless. No round emits all pairs of a group.
An entry of more than ``BLOCK`` points first meets one block of them, its hub; after that only texts outside the label
that most of the entry has are held against the others. No link between texts of different components is lost, and a
group of near copies costs about as many pairs as it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import among, tidy, without, written
from linkgraph.llm.omh import _ODD, mix
from linkgraph.llm.tokens import release

#: Groups of a coarse point and of the finest; points of a leaf, leaves of a node, points of a block of an entry.
DIMS, FINEST, LEAF, FANOUT, BLOCK = 128, 2048, 32, 16, 4096
#: Cells of a text by which its pairs are told to have met before.
LOWS, NEVER = 16, (1 << 63) - 1
#: Groups that corpus counts are kept for, and the parts that they are summed in.
RARITY_BITS, PARTS = 20, 64
#: Pairs that are bounded at a time, rows that are gathered before small entries are searched, and pairs of a forest's step.
PAIRS, ROWS, STEP = 20_000, 8_000, 500_000

PAIR = [("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, the hash of all; of none, nothing."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out += h[j : n + j] * _ODD[j]
    return np.unique(mix(out))


def point(own: np.ndarray) -> bytes:
    """Counts of the power of two of groups that is next to the set's size; counts that a byte can't hold make all counts the largest, so bounds stay bounds."""
    groups = min(FINEST, max(DIMS, 1 << max(0, len(own) - 1).bit_length()))
    counts = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 255 else np.full(groups, 255, np.uint8).tobytes()


def arrow(kinds: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def least_overlap(a, b, num: int, den: int):
    """Least overlap of linked sets of these sizes: ``den * o >= num * (a + b - o)``."""
    return -(-(num * (a + b)) // (den + num))


class Points:
    """ids, sizes, labels and points of some texts, one row each."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, points: list[bytes]):
        self.ids, self.sizes, self.labels, self.points = ids, sizes.astype(np.int64), labels, points
        self.groups = np.fromiter(map(len, points), np.int64, len(points))
        self.coarse = self.folded(np.arange(len(ids)), DIMS)

    def folded(self, at: np.ndarray, dims: int) -> np.ndarray:
        """Counts of these rows in so many groups (no more than they have)."""
        out = np.zeros((len(at), dims), np.uint16)
        have = self.groups[at]
        for g in np.unique(have):
            own = np.flatnonzero(have == g)
            wide = np.frombuffer(b"".join([self.points[i] for i in at[own].tolist()]), np.uint8).reshape(len(own), -1, dims)
            out[own] = wide[:, 0] if g == dims else wide.sum(1, dtype=np.uint16)
        return out


def bounded(x: Points, i: np.ndarray, y: Points, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of unlike labels, those whose coarse and then whose fine bound reaches the threshold: i, j, bound / least overlap."""
    found = []
    for a in range(0, len(i), PAIRS):
        p, q = i[a : a + PAIRS], j[a : a + PAIRS]
        need = least_overlap(x.sizes[p], y.sizes[q], num, den)
        ok = (x.labels[p] != y.labels[q]) & (need <= np.minimum(x.sizes[p], y.sizes[q]))
        p, q, need = p[ok], q[ok], need[ok]
        ok = np.minimum(x.coarse[p], y.coarse[q]).sum(1, dtype=np.int64) >= need
        p, q, need = p[ok], q[ok], need[ok]
        groups, bound = np.minimum(x.groups[p], y.groups[q]), np.zeros(len(p), np.int64)
        for g in np.unique(groups):
            own = np.flatnonzero(groups == g)
            for s in range(0, len(own), 1000):
                some = own[s : s + 1000]
                bound[some] = np.minimum(x.folded(p[some], int(g)), y.folded(q[some], int(g))).sum(1, dtype=np.int64)
        ok = bound >= need
        found.append((p[ok], q[ok], bound[ok] / need[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Tree:
    """Points in the order of sizes below leaves and nodes with the maxima of their coarse counts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, points: list[bytes]):
        self.order = order = np.lexsort((ids, sizes))
        self.points = Points(ids[order], sizes[order], labels[order], [points[x] for x in order.tolist()])
        self.leaves, self.nodes = (self._level(np.arange(0, len(ids), w), w) for w in (LEAF, LEAF * FANOUT))

    def _level(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        p, last = self.points, np.minimum(starts + width, len(self.points.ids)) - 1
        return starts, np.maximum.reduceat(p.coarse, starts, axis=0), p.sizes[starts], p.sizes[last], np.minimum.reduceat(p.labels, starts), np.maximum.reduceat(p.labels, starts)

    def entered(self, level: tuple[np.ndarray, ...], among: np.ndarray, query: tuple, num: int, den: int) -> np.ndarray:
        """Those of a level's nodes that can hold a partner of the query node: sizes, labels, then the bound of the maxima."""
        top, low, high, first, last = query
        _, tops, lows, highs, firsts, lasts = (c[among] for c in level)
        ok = (highs * den >= low * num) & (high * den >= lows * num) & ~((first == last) & (firsts == lasts) & (first == firsts))
        among, tops, lows = among[ok], tops[ok], lows[ok]
        return among[np.minimum(tops, top).sum(1, dtype=np.int64) >= least_overlap(low, lows, num, den)]

    def pairs(self, other: "Tree", num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row here, row there, score) of the surviving pairs, leaf by leaf."""
        starts = self.leaves[0]
        for k, s in enumerate(starts):
            query = tuple(c[k] for c in self.leaves[1:])
            nodes = other.entered(other.nodes, np.arange(len(other.nodes[0])), query, num, den)
            below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < len(other.leaves[0])]
            if other is self:
                below = below[below >= k]
            at = other.entered(other.leaves, below, query, num, den)
            if not len(at):
                continue
            here = np.arange(s, min(s + LEAF, len(self.points.ids)))
            there = (other.leaves[0][at][:, None] + np.arange(LEAF)).ravel()
            there = there[there < len(other.points.ids)]
            i, j = (x.ravel() for x in np.meshgrid(here, there, indexing="ij"))
            if other is self:
                i, j = i[i < j], j[i < j]
            found = bounded(self.points, i, other.points, j, num, den)
            if len(found[0]):
                yield found


class Forest:
    """Pairs that connect what those before them, best score first within a step, left apart."""

    def __init__(self, n: int):
        self.root, self.edges, self.left = np.arange(n), [], False

    def add(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(-score, kind="stable")
        for a in range(0, len(order), 10_000):
            own = order[a : a + 10_000]
            apart = own[self.root[i[own]] != self.root[j[own]]]
            taken, parent = 0, {}

            def top(x):
                while parent.get(x, x) != x:  # noqa: B023
                    parent[x] = parent.get(parent[x], parent[x])  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            for p, q in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                x, y = top(int(self.root[p])), top(int(self.root[q]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    self.edges.append((p, q))
                    taken += 1
            if parent:
                move = np.arange(len(self.root))
                move[list(parent)] = [top(x) for x in parent]
                self.root = move[self.root]
            self.left |= taken < len(own)


def first_met(lows: np.ndarray, cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs in these cells, which are in no smaller cell together, as far as the least cells of both can tell."""
    out = np.ones(len(i), bool)
    for s in range(0, len(i), PAIRS):
        p, q, c = lows[i[s : s + PAIRS]], lows[j[s : s + PAIRS]], cells[i[s : s + PAIRS]]
        out[s : s + PAIRS] = ~((p[:, :, None] == q[:, None, :]) & (p < c[:, None])[:, :, None]).any((1, 2))
    return out


class Opened:
    """Remembers who has a surviving partner that it meets here first."""

    def __init__(self, lows: np.ndarray, cells: np.ndarray):
        self.edges, self.left, self.rows, self.lows, self.cells = [], False, np.zeros(len(cells), bool), lows, cells

    def add(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        ok = first_met(self.lows, self.cells, i, j)
        self.rows[i[ok]] = self.rows[j[ok]] = True


class Links:
    """Pairs that the whole sets confirm and that join two labels, best bound first; the pairs between joined labels are not tried."""

    def __init__(self, labels: np.ndarray, sets: list[bytes], lows: np.ndarray, cells: np.ndarray, num: int, den: int):
        self.labels, self.sets, self.lows, self.cells, self.num, self.den = labels, sets, lows, cells, num, den
        self.parent, self.edges, self.left = {}, [], False

    def top(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            self.parent[x] = self.parent.get(self.parent[x], self.parent[x])
            x = self.parent[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        ok = first_met(self.lows, self.cells, i, j)
        i, j, score = i[ok], j[ok], score[ok]
        for k in np.argsort(-score, kind="stable").tolist():
            p, q = int(i[k]), int(j[k])
            x, y = self.top(int(self.labels[p])), self.top(int(self.labels[q]))
            if x == y:
                continue
            a, b = (np.frombuffer(self.sets[r], np.uint64) for r in (p, q))
            same = len(np.intersect1d(a, b, assume_unique=True))
            if self.den * same >= self.num * (len(a) + len(b) - same):
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((p, q))


def candidates(members: DataFrame, num: int, den: int, mode: str = "forest") -> DataFrame:
    """By mode: a, b of a forest of surviving pairs, and cell alone of an entry whose pairs were not all taken; of "open",
    a and cell of who has a surviving partner; of "links", a, b of verified links that join labels.

    Rows: cell, i, j, side, id, n, point, label, but for a forest lows (the id's least cells, so that a pair of many cells is
    looked at in one), and for links set. The rows of one (cell, i, j) are an entry, or two of its blocks.
    """

    def work(labels: np.ndarray, sets: list[bytes], lows: list[bytes], cells: np.ndarray):
        if mode == "forest":
            return Forest(len(labels))
        low = np.frombuffer(b"".join(lows), np.int64).reshape(len(lows), LOWS)
        return Opened(low, cells) if mode == "open" else Links(labels, sets, low, cells, num, den)

    def whole(own: list[np.ndarray], points: list[bytes], sets: list[bytes], lows: list[bytes]) -> Iterator[pa.RecordBatch]:
        """An entry, or two blocks, by trees."""
        cell, _, _, side, ids, sizes, labels = own
        places = [at for s in (0, 1) if len(at := np.flatnonzero(side == s))]
        sides = [Tree(ids[at], sizes[at], labels[at], [points[x] for x in at.tolist()]) for at in places]
        if own[1][0] != own[2][0] and len(sides) < 2:
            return
        a, b, shift = sides[0], sides[-1], len(sides[0].points.ids) * (len(sides) - 1)
        order = np.concatenate([at[tree.order] for at, tree in zip(places, sides, strict=True)])
        forest, held, n = work(labels[order], *([c[x] for x in order.tolist()] if c else [] for c in (sets, lows)), cell), [], 0
        for i, j, score in a.pairs(b, num, den):
            held.append((i, j + shift, score))
            n += len(i)
            if n >= STEP:
                forest.add(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            forest.add(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield from closed(forest, ids[order], cell, cell[:1])

    def closed(forest, ids: np.ndarray, own: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """own: the cell of each row."""
        if mode == "open" and forest.rows.any():
            some = ids[forest.rows]
            yield arrow(PAIR, [some, pa.nulls(len(some), pa.int64()), own[forest.rows]])
        if forest.edges:
            i, j = np.array(forest.edges).T
            yield batch_of(ids[i], ids[j])
        if forest.left:
            yield arrow(PAIR, [[None] * len(cells), [None] * len(cells), cells])

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return arrow(PAIR, [pairs[:, 0], pairs[:, 1], pa.nulls(len(pairs), pa.int64())])

    def small(own: list[np.ndarray], points: list[bytes], sets: list[bytes], lows: list[bytes], starts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries of a leaf each, all at once."""
        rows = Points(own[4], own[5], own[6], points)
        some = [(starts[counts == m][:, None] + np.stack(np.triu_indices(m, 1))[:, None, :]).reshape(2, -1) for m in np.unique(counts) if m > 1]
        if not some:
            return
        i, j = np.concatenate(some, 1)
        i, j, score = bounded(rows, i, rows, j, num, den)
        if not len(i):
            return
        forest = work(rows.labels, sets, lows, own[0])
        forest.add(i, j, score)
        if mode != "forest":
            yield from closed(forest, rows.ids, own[0], own[0][:0])
            return
        taken = dict(zip(*np.unique(own[0][[p for p, _ in forest.edges]], return_counts=True), strict=True))
        cells, met = np.unique(own[0][i], return_counts=True)
        more = np.array([c for c, n in zip(cells, met, strict=True) if n > taken.get(c, 0)], np.int64)
        forest.left = len(more) > 0
        yield from closed(forest, rows.ids, own[0], more)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress

        def groups(own: list[np.ndarray], points: list[bytes], sets: list[bytes], lows: list[bytes]) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], np.any([np.diff(c) != 0 for c in own[:3]], axis=0)]))
            counts = np.diff(np.append(starts, len(points)))
            leaf = (counts <= LEAF) & np.array([not own[3][s : s + n].any() for s, n in zip(starts, counts, strict=True)])
            for s, n in zip(starts[~leaf], counts[~leaf], strict=True):
                yield from whole([c[s : s + n] for c in own], points[s : s + n], sets[s : s + n], lows[s : s + n])
            if leaf.any():
                at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[leaf], counts[leaf], strict=True)])
                n = counts[leaf]
                yield from small([c[at] for c in own], [points[x] for x in at.tolist()], *([c[x] for x in at.tolist()] if c else [] for c in (sets, lows)), np.cumsum(n) - n, n)

        held: list[list[np.ndarray]] = []
        points: list[bytes] = []
        sets: list[bytes] = []
        lows: list[bytes] = []
        step = ROWS // 8 if mode == "links" else ROWS
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                if mode == "links":
                    sets += part.column("set").to_pylist()
                if mode != "forest":
                    lows += [np.array([*x[:LOWS], *[NEVER] * (LOWS - len(x))], np.int64).tobytes() for x in part.column("lows").to_pylist()]
                held.append([part.column(c).to_numpy() for c in ("cell", "i", "j", "side", "id", "n", "label")])
                points += [expand(x) for x in part.column("point").to_pylist()]
                own = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = np.flatnonzero(np.any([c != c[-1] for c in own[:3]], axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # what stands from here on may go on
                if cut >= step // 2:
                    yield from groups([c[:cut] for c in own], points[:cut], sets[:cut], lows[:cut])
                    own, points, sets, lows = [c[cut:] for c in own], points[cut:], sets[cut:], lows[cut:]
                held = [own]
        if points:
            yield from groups([np.concatenate(c) for c in zip(*held, strict=True)], points, sets, lows)

    return members.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(tidy(search), "a long, b long, cell long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold. Texts take far fewer bytes in an exchange than sets of hashes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, y = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 100):  # texts may be long: a few are copied at a time
                part = batch.slice(at, 100)
                for a, b, s, t in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                    x = shingles(s, k)
                    if t != last:  # rows of one b mostly follow one another
                        last, y = t, shingles(t, k)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if same and den * same >= num * (len(x) + len(y) - same):  # two empty texts link nothing
                        out.append((a, b))
            if out:
                yield arrow(PAIR[:2], [*zip(*out, strict=True)])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every id in a link: labels spread over links, then to the label's own label."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("far"))
        new = written(spread.join(jump, spread.label == jump.at, "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and key (a digest of the set, null if it is empty) of every row; and, with n null, counts of one part of the groups by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("task", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]
        groups, task = np.zeros(1 << RARITY_BITS, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part, sets = batch.slice(s, 500), []
                for text in part.column(1):
                    sets.append(shingles(text.as_py(), k))
                np.add.at(groups, (np.concatenate(sets) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                empty = [None] * len(sets)
                yield arrow(kinds, [part.column(0), [len(x) for x in sets], digests, empty, empty, empty])
        if groups.any():
            rows = [zstandard.compress(x.tobytes(), 1) for x in np.split(groups, PARTS)]
            none = [None] * PARTS
            yield arrow(kinds, [none, none, none, [task] * PARTS, range(PARTS), rows])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, key binary, task int, part int, counts binary")


def rarity(counted: DataFrame) -> np.ndarray:
    """A rank for each group of shingles, by its count over all rows: one of 16 steps a doubling.

    Counts of tasks are summed by part in two steps, so no task sums more than a share of them; ``PARTS`` rows of fixed
    size reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(data), np.int64)
        if sums:
            yield arrow([("part", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())], [[*sums], [0] * len(sums), [zstandard.compress(x.tobytes(), 1) for x in sums.values()]])

    some = counted.select("part", F.pmod("task", F.lit(64)).alias("task"), "counts").repartition("part", "task").mapInArrow(tidy(add), "part int, task int, counts binary")
    out = np.zeros(1 << RARITY_BITS, np.int64)
    width = len(out) // PARTS
    for r in some.repartition("part").mapInArrow(tidy(add), "part int, task int, counts binary").collect():
        out[r.part * width : (r.part + 1) * width] += np.frombuffer(zstandard.decompress(r.counts), np.int64)
    return np.round(16 * np.log2(out + 1)).astype(np.uint16)


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; texts link at ``den * intersection >= num * union``.

    A null or empty text, and one of white space, has no shingle and no link: it is its own component. Rows with a null
    doc_id get neither links nor a component. Rows that share a doc_id are one vertex with the links of each of their texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    both = written(keys(rows, k))
    keyed = both.where(F.col("n").isNotNull()).select("doc_id", "n", "key")
    sent = spark.sparkContext.broadcast(rarity(both.where(F.col("n").isNull())))
    first = written(keyed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("id")))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                ids, cells = [], []
                for doc, text in zip(batch.column(0)[s : s + 500].to_pylist(), batch.column(1)[s : s + 500], strict=True):
                    own = shingles(text.as_py(), k)
                    if len(own):
                        keep = len(own) - -(-num * len(own) // den) + 1
                        rare = np.lexsort((own, sent.value[own >> np.uint64(64 - RARITY_BITS)]))[:keep]
                        cells.append(own[rare].view(np.int64))
                        ids.append(np.full(keep, doc, np.int64))
                if ids:
                    yield arrow([("id", pa.int64()), ("cell", pa.int64())], [np.concatenate(ids), np.concatenate(cells)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                sets = [shingles(x.as_py(), k) for x in batch.column(1)[s : s + 500]]
                yield arrow([("id", pa.int64()), ("n", pa.int64()), ("point", pa.binary())], [batch.column(0)[s : s + 500], [len(x) for x in sets], [squeeze(point(x)) for x in sets]])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                yield arrow([("id", pa.int64()), ("set", pa.binary())], [batch.column(0)[s : s + 200], [shingles(x.as_py(), k).tobytes() for x in batch.column(1)[s : s + 200]]])

    # of texts with equal sets only the first goes on
    firsts = among(known, F.col("doc_id"), first.select("id"))
    # one exchange, of 16 bytes a row, finds the entries that more than one id shares; a window over a hot entry spills
    by_cell = Window.partitionBy("cell")
    placed = firsts.mapInArrow(tidy(entries), "id long, cell long").select("id", "cell", F.min("id").over(by_cell).alias("low"), F.max("id").over(by_cell).alias("high"))
    shared = written(placed.where("low < high").select("id", "cell"))
    several = written(shared.join(first.select("id").distinct(), "id", "left_semi").distinct())
    entry = several.groupBy("cell").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("sign")).where(F.col("size") > 1)
    one_each = entry.groupBy("size", "sign").agg(F.min("cell").alias("cell"))  # entries with the same members are one
    members = written(several.join(written(one_each.select("cell", "size")), "cell"))
    points = written(among(known, F.col("doc_id"), members.select("id")).mapInArrow(tidy(make), "id long, n long, point binary"))
    sized = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    zero = F.lit(0)

    columns = ("cell", "i", "j", "side", "id", "n", "point", "label")

    def verified(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links, and the entries of which pairs are left."""
        found = written(candidates(dealt.join(points, "id").select(*columns), num, den))
        pairs = written(found.where(F.col("a").isNotNull()).select("a", "b").distinct())
        texts = among(known, F.col("doc_id"), pairs.select(F.explode(F.array("a", "b")).alias("id"))).select(F.col("doc_id").alias("id"), "text")
        return written(verify(pairs, texts, k, num, den)), found.where(F.col("a").isNull()).select("cell").distinct()

    def blocked(mixed: DataFrame) -> DataFrame:
        """Whole small entries; of large ones, the texts outside the label that most have, in blocks of their own, against all blocks."""
        one = mixed.where("blocks = 1").select("cell", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", "label")
        stray = mixed.where("blocks > 1 and label <> usual").select("cell", F.pmod(F.xxhash64("id"), F.col("strays")).cast("int").alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), zero.alias("side"), "id", "label")
        every = mixed.where("blocks > 1").select("cell", F.explode(F.sequence(zero, F.col("strays") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "label")
        return one.unionByName(stray).unionByName(every)

    # the hub, block 0 of a large entry, meets every block
    target = F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("block"))
    hubs = sized.select("cell", zero.alias("i"), F.explode(target).alias("j"), (F.col("block") > 0).cast("int").alias("side"), "id", F.col("id").alias("label"))
    links, left = verified(hubs)
    # an id with several texts ties the groups of copies that they stand in
    tied = keyed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id")
    ties = keyed.join(tied, "doc_id", "left_semi").join(first, "key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(ties)
    labels = components(links)
    again = sized.join(left, "cell", "left_semi").unionByName(sized.where("blocks > 1").join(left, "cell", "left_anti")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    usual = again.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("label", "n").alias("usual"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("most"))
    mixed = written(again.join(usual.where("labels > 1"), "cell").withColumn("strays", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")))
    # who has a surviving partner of another label, and then the links between these, on their sets
    lows = written(mixed.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("cell")), 1, LOWS).alias("lows")))  # of the few cells that a text is in
    opened = written(candidates(blocked(mixed).join(points.join(lows, "id"), "id").select(*columns, "lows"), num, den, "open").select(F.col("a").alias("id"), "cell").distinct())
    rest = written(mixed.join(opened, ["cell", "id"], "left_semi"))
    sets = among(known, F.col("doc_id"), rest.select("id").distinct()).mapInArrow(tidy(hashed), "id long, set binary")
    more = written(candidates(blocked(rest).join(points.join(lows, "id").join(sets, "id"), "id").select(*columns, "lows", "set"), num, den, "links").select("a", "b"))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = first.join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("component_id"))
    linked = keyed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def dedupe(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id.

    Rows that repeat a doc_id stay or go together, and those with a null doc_id stay.
    """
    found = join(docs, k, num, den).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return without(docs, "doc_id", written(found))


def oracle(k: int = 4, num: int = 85, den: int = 100, kept: bool = False) -> str:
    """The same in DuckDB's SQL, without an index: linked sets share one of their rarest shingles, and all such pairs are verified.

    Of n shingles ``n - ceil(num * n / den) + 1`` are enough, since two linked sets have fewer unlike ones. Equal sets are one.
    """
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    more = ", coalesce(o.least, doc_id) = doc_id AS kept" if kept else ""
    return rf"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s FROM words WHERE len(w) > 0)),
numbered AS (SELECT s, row_number() OVER (ORDER BY count(*), s) AS r FROM shingle GROUP BY s),
sets AS MATERIALIZED (SELECT doc_id, list_sort(list(r)) AS v FROM shingle JOIN numbered USING (s) GROUP BY doc_id),
point AS MATERIALIZED (SELECT v, min(doc_id) AS p, len(v) AS n FROM sets GROUP BY v),
rare AS MATERIALIZED (SELECT p, unnest(v[1:n - ({num} * n + {den - 1}) // {den} + 1]) AS r FROM point),
pair AS MATERIALIZED (SELECT DISTINCT x.p AS a, y.p AS b FROM rare x JOIN rare y USING (r) WHERE x.p < y.p),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN point x ON x.p = a JOIN point y ON y.p = b WHERE {num} * greatest(x.n, y.n) <= {den} * least(x.n, y.n) AND {num + den} * len(list_intersect(x.v, y.v)) >= {num} * (x.n + y.n)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT p, p FROM point UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
top AS (SELECT a AS p, min(b) AS least FROM reach GROUP BY a),
o AS (SELECT doc_id, CAST(n AS BIGINT) AS n, least FROM sets JOIN point USING (v) JOIN top USING (p))
SELECT doc_id, coalesce(o.n, 0) AS n_shingles, coalesce(o.least, doc_id) AS component_id{more} FROM documents LEFT JOIN o USING (doc_id)"""
