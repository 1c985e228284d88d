"""Operator 8: best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so an instance of any size is a histogram with at most ``capacity`` classes.
The reduction and best-fit run on that histogram, in multiplicities, and give a short list of patterns (which lengths
fill a sequence, and how many sequences look like that). The documents never leave Spark: each piece gets its rank
among the pieces of its length, and rank and pattern list give its sequence and offset.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import crc_u32, tidy, written
from linkgraph.llm.tokens import encoded

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every whole text: only documents of more than ``capacity`` ids are cut.

    ``nth`` counts the pieces of the same length that the same task met before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    size = len(own)
                    rows.append((doc, k, at, size, crc_u32(own), part, int(met[size])))
                    met[size] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), PIECES)


def reduce_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sequences that dominate every alternative and takes them out of ``counts``, largest length first.

    For a length ``j`` with room ``r = capacity - j``: it stands alone if nothing fits; it is joined with the largest
    fitting ``i`` if ``i == r``, or if no two pieces fit together in ``r``; it is joined with a pair ``a + b == r``
    only if no three pieces fit and ``i <= a`` (nothing that fits is larger than either of the pair).
    """
    fixed = []
    have = sorted(x for x, n in counts.items() if n)

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                have.remove(x)

    for j in sorted(counts, reverse=True):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1  # the piece itself is not among its partners
            fits = have[: bisect_left(have, room + 1)]
            fits = [x for x in fits if counts[x]]
            smallest = [x for x in fits[:3] for _ in range(min(3, counts[x]))][:3]
            counts[j] += 1
            if not fits:
                take((j,), counts[j])
                continue
            i = fits[-1]
            if i == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                take((j, i), counts[j] // 2 if i == j else min(counts[j], counts[i]))
                continue
            if len(smallest) < 3 or sum(smallest) > room:
                counts[j] -= 1
                a = next((a for a in fits if a <= room - a and counts.get(room - a, 0) > (a == room - a)), None) if i <= room // 2 else None
                counts[j] += 1
                if a is not None and i <= a and j not in (a, room - a):
                    b = room - a
                    take((j, a, b), min(counts[j], counts[a] // 2 if a == b else min(counts[a], counts[b])))
                    continue
            break
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing in multiplicities: groups of sequences with the same content, by the room they have left."""
    rooms: list[int] = []  # ascending, each once
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], times: int) -> None:
        left = capacity - sum(content)
        if left not in groups:
            groups[left] = []
            insort(rooms, left)
        groups[left].append((content, times))

    for size in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if full := left // each:
                    put((size,) * each, full)
                if left % each:
                    put((size,) * (left % each), 1)
                left = 0
                continue
            room = rooms[k]
            content, times = groups[room].pop()
            each = min(room // size, left)
            now = min(times, left // each)
            if times > now:
                groups[room].append((content, times - now))
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            put(content + (size,) * each, now)
            left -= each * now
    return [x for own in groups.values() for x in own]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of all sequences: the dominance reduction first, best-fit for what is left."""
    counts = dict(counts)
    return reduce_counts(counts, capacity) + best_fit(counts, capacity)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[np.ndarray]]:
    """By length: the first rank of each run of a pattern place, its first sequence number and its offset."""
    out: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in plan:
        at = 0
        for size in lengths:
            out.setdefault(size, [[], [], []])
            for column, value in zip(out[size], (used.get(size, 0), first, at), strict=True):
                column.append(value)
            used[size] = used.get(size, 0) + times
            at += size
        first += times
    return {size: [np.array(c, np.int64) for c in columns] for size, columns in out.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null text is empty (its end id is packed); null or repeated ids are packed like any other; an empty table gives
    no rows; other columns are ignored. Only the histogram (at most ``capacity`` rows) reaches the driver, and only the
    pattern list (its size follows the classes, not the documents) is sent back.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity))
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    places = spark.sparkContext.broadcast(slots(patterns(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if not len(own):
                    continue
                ranks, firsts, offsets = places.value[int(size[own[0]])]
                k = np.searchsorted(ranks, rank[own], side="right") - 1
                seq[own], offset[own] = firsts[k] + rank[own] - ranks[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "part"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
