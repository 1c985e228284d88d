"""The declared dependencies of files: rings, and who depends on whom.

A project declares them by hand, so as a dictionary they stand on the driver, where everything is linear in the
declaration but for the rings themselves. Derived from tables they are a DataFrame (path, target), and no step holds
more than a ring's own files in one place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.sources.scratch import written


def strong(after: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each after all that it leads to; vertices and edges are visited by name."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    out: list[list[str]] = []
    for top in sorted(after):
        if top in number:
            continue
        todo: list[tuple[str, Iterator[str]]] = []

        def enter(v: str) -> None:
            number[v] = low[v] = len(number)
            held.append(v)
            inside.add(v)
            todo.append((v, iter(sorted(set(after.get(v, ()))))))  # noqa: B023

        enter(top)
        while todo:
            v, rest = todo[-1]
            for w in rest:
                if w not in number:
                    enter(w)
                    break
                if w in inside:
                    low[v] = min(low[v], number[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == number[v]:
                    cut = len(held) - 1
                    while held[cut] != v:
                        cut -= 1
                    out.append(held[cut:])
                    inside.difference_update(held[cut:])
                    del held[cut:]
    return out


def circuits(after: dict[str, list[str]], start: str) -> Iterator[list[str]]:
    """The elementary circuits through ``start``: a vertex that led nowhere is not tried again until one it waits for closes a circuit."""
    blocked, waiting, closes = {start}, defaultdict(set), set()
    path, todo = [start], [(start, iter(after[start]))]
    while todo:
        v, rest = todo[-1]
        for w in rest:
            if w == start:
                yield list(path)
                closes.update(path)
            elif w not in blocked:
                path.append(w)
                blocked.add(w)
                closes.discard(w)
                todo.append((w, iter(after[w])))
                break
        else:
            todo.pop()
            path.pop()
            if v in closes:
                free = [v]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.remove(x)
                        free.extend(waiting.pop(x, ()))
            else:
                for w in after[v]:
                    waiting[w].add(v)


def rings(depends: dict[str, Iterable[str]]) -> list[list[str]]:
    """The elementary cycles, from a file to the files that depend on it; each from its first file by name, in that order.

    Only files of one strongly connected component are searched, and again only what is strongly connected without the
    files before the ring's first one, so a project without rings takes the time of its declaration.
    """
    after: dict[str, list[str]] = {}
    for f, targets in depends.items():
        for g in targets:
            after.setdefault(g, []).append(f)
    out: list[list[str]] = []
    for own in strong(after):
        members = set(own)
        while members:
            inner = {v: sorted({w for w in after.get(v, ()) if w in members}) for v in members}
            parts = [p for p in strong(inner) if len(p) > 1 or p[0] in inner[p[0]]]
            if not parts:
                break
            start = min(min(p) for p in parts)
            part = set(next(p for p in parts if start in p))
            out += circuits({v: [w for w in inner[v] if w in part] for v in part}, start)
            members = {v for p in parts for v in p} - {start}
    return sorted(out, key=lambda ring: ring[0])


def index(depends: dict[str, Iterable[str]]) -> list[tuple[str, int, int, int, bool]]:
    """(file, part, first, low, ringed) of each file: which files it depends on, in three numbers.

    Parts (strongly connected components) are numbered as a depth-first search leaves them. A part depends on all parts
    from ``first`` to itself, which the search met below it, and on none that is below ``low`` or above itself.
    ``ringed``: its files depend on themselves.
    """
    after = {f: sorted(set(gs)) for f, gs in depends.items()}
    parts = strong(after)
    part = {f: k for k, p in enumerate(parts) for f in p}
    low: list[int] = []
    first: list[int] = []
    claimed = [False] * len(parts)
    for k, p in enumerate(parts):
        below = sorted({part[g] for f in p for g in after.get(f, ())} - {k})
        low.append(min([k, *(low[x] for x in below)]))
        # the search left the parts below this one just before it; what nothing else has claimed stands in one row
        start = k
        while start > 0 and not claimed[start - 1] and any(x == start - 1 or first[x] <= start - 1 <= x for x in below):
            start = first[start - 1]
        for x in range(start, k):
            claimed[x] = True
        first.append(start)
    return [(f, k, first[k], low[k], len(p) > 1 or p[0] in after.get(p[0], ())) for k, p in enumerate(parts) for f in p]


def declared(spark, depends: dict[str, Iterable[str]] | DataFrame) -> DataFrame:
    """path, target of a declaration, each pair once."""
    if isinstance(depends, DataFrame):
        return depends.select("path", "target").where(F.col("path").isNotNull() & F.col("target").isNotNull()).distinct()
    return spark.createDataFrame(sorted({(f, g) for f, gs in depends.items() for g in gs}) or [("", "")], "path string, target string").where("path <> ''")


def reached(pairs: DataFrame, depends: dict[str, Iterable[str]] | DataFrame) -> DataFrame:
    """Those of the pairs (path, target) in which the path depends on the target, directly or over others.

    Only what is asked is answered. Of a dictionary the index decides most pairs at once; the others go on step by step
    to the parts that may still lead to their target. Of a DataFrame, the files that are asked for go on along it.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("path", "target").distinct()
    if isinstance(depends, DataFrame):
        return walked(pairs, declared(spark, depends))
    rows = index(depends)
    part = {r[0]: r[1] for r in rows}
    marks = spark.createDataFrame(rows or [("", 0, 0, 0, False)], "file string, part int, first int, low int, ringed boolean")
    own = marks.toDF("path", "part", "first", "low", "ringed")
    theirs = marks.select(F.col("file").alias("target"), F.col("part").alias("to"), F.col("low").alias("to_low"))
    asked = pairs.join(own, "path").join(theirs, "target")
    verdict = F.when(F.col("part") == F.col("to"), F.col("ringed")).when(F.col("to").between(F.col("first"), F.col("part")), True).when((F.col("to") > F.col("part")) | (F.col("to_low") < F.col("low")), False)
    steps = spark.createDataFrame(sorted({(part[f], part[g]) for f, gs in depends.items() for g in gs if part[f] != part[g]}) or [(-1, -1)], "part int, next int")
    at = marks.select(F.col("part").alias("next"), "first", "low").distinct()
    open_ = written(asked.withColumn("yes", verdict).select("path", "target", "part", "to", "to_low", "yes"))
    out = open_.where("yes").select("path", "target")
    while True:
        moved = open_.where("yes is null").join(steps, "part").join(at, "next").select("path", "target", F.col("next").alias("part"), "to", "to_low", "first", "low").distinct()
        told = F.when(F.col("to").between(F.col("first"), F.col("part")), True).when((F.col("to") > F.col("part")) | (F.col("to_low") < F.col("low")), False)
        open_ = written(moved.withColumn("yes", told).where("yes is null or yes").select("path", "target", "part", "to", "to_low", "yes"))
        if open_.isEmpty():
            return out.distinct()
        out = out.unionByName(open_.where("yes").select("path", "target"))


def walked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs that a walk from their path along the edges meets; a file that was met from a path is not met again."""
    found = frontier = None
    starts = pairs.select("path").distinct()
    while True:
        if frontier is None:
            step = starts.join(edges, "path").select("path", "target")
        else:
            step = frontier.join(edges.toDF("target", "next"), "target").select("path", F.col("next").alias("target")).distinct().join(found, ["path", "target"], "left_anti")
        frontier = written(step)
        if found is not None and frontier.isEmpty():
            return pairs.join(found, ["path", "target"], "left_semi")
        found = frontier if found is None else found.unionByName(frontier)


def cyclic(edges: DataFrame) -> DataFrame:
    """path, target of the edges between files that are entered and left, without end: what lies on rings, or between two."""
    rest = edges.where("path <> target")
    n = None
    while True:
        ends = rest.select("path").intersect(rest.select(F.col("target").alias("path")))
        rest = written(rest.join(ends, "path", "left_semi").join(ends.withColumnRenamed("path", "target"), "target", "left_semi").select("path", "target"))
        last, n = n, rest.count()
        if n in (0, last):
            return rest.unionByName(edges.where("path = target"))


def clusters(edges: DataFrame) -> DataFrame:
    """path, target, cluster: the least file of those that are connected, whatever the direction."""
    both = written(edges.select("path", "target").unionByName(edges.select(F.col("target").alias("path"), F.col("path").alias("target"))).distinct())
    labels = written(both.groupBy("path").agg(F.least(F.min("target"), F.first("path")).alias("cluster")))
    while True:
        near = both.join(labels.withColumnRenamed("path", "target"), "target").groupBy("path").agg(F.min("cluster").alias("near"))
        new = written(labels.join(near, "path").select("path", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster")))
        labels = new.select("path", "cluster")
        if new.where("old <> cluster").isEmpty():
            return edges.join(labels, "path").select("path", "target", "cluster")


def ring_table(edges: DataFrame) -> DataFrame:
    """ring: the files of each elementary cycle, as ``rings`` gives them, of declarations that are a table.

    Files that are on no ring fall away first; each connected rest is searched by a task of its own, since its rings are
    found together.
    """

    def search(own: pd.DataFrame) -> pd.DataFrame:
        depends: dict[str, list[str]] = {}
        for f, g in zip(own["path"], own["target"], strict=True):
            depends.setdefault(f, []).append(g)
        return pd.DataFrame({"ring": rings(depends)})

    return clusters(cyclic(edges)).groupBy("cluster").applyInPandas(search, "ring array<string>")
