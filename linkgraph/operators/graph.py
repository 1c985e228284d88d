"""The link graph and its questions: coverage along a chain of types, gaps, and the impact of a change.

nodes: id, type, path, line, level, title, pos. edges: src, dst, kind ('reference' or 'containment'), from the
identifier that is mentioned to the one whose section mentions it. kids: parent, child of the heading tree, or None.
typed: the references with the types of both ends where a source knows them (src, dst, src_type, dst_type; a pair may
be repeated, no end refers to itself), else None. All identifiers of a file have its type. flat: a source knows that all
its identifiers stand on the primary level of their file. label: identifiers may be any value that can be grouped and
joined, such as a struct of numbers; results have them as the text that this makes of one. nested: ancestor, id, depth
within each document, where a source can tell, self at depth 0. repeated: identifiers with several definitions, None if
there are none; kids then also has the place of the child, for the order in which it is met.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions.idgrammar import natural_key
from linkgraph.operators.prefix import running
from linkgraph.sources.scratch import written

REFERENCE, CONTAINMENT = "reference", "containment"
COMPLETE, PARTIAL, MISSING = "complete", "partial", "missing"


@dataclass
class LinkGraph:
    nodes: DataFrame
    edges: DataFrame
    chain: list[str]
    kids: DataFrame | None = None
    typed: DataFrame | None = None
    flat: bool = False
    nested: DataFrame | None = None
    repeated: DataFrame | None = None
    label: Callable[[Column], Column] | None = None

    def name(self, ident: str) -> Column:
        """The identifier as text."""
        return F.col(ident) if self.label is None else self.label(F.col(ident))


def first_wins(rows: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row a key: the first in document order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """No loops and one edge a pair; a reference takes the place of a containment, never the other way round."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.max("kind").alias("kind"))


def closure(kids: DataFrame) -> DataFrame:
    """ancestor, id, depth (the least) of the containment tree, without loops; self at depth 0.

    Duplicate identifiers can close cycles, so a pair that was met is not followed again.
    """
    ends = kids.select(F.col("parent").alias("id")).union(kids.select("child")).distinct()
    met = written(ends.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth")))
    frontier, depth = met, 0
    while True:
        depth += 1
        step = frontier.join(kids, frontier.id == kids.parent).select("ancestor", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        frontier = written(step.join(met.select("ancestor", "id"), ["ancestor", "id"], "left_anti").select("ancestor", "id", "depth"))
        if frontier.isEmpty():
            return met
        met = met.unionByName(frontier)


def descendants(graph: LinkGraph) -> DataFrame:
    """ancestor, id, depth (the least) of what each node contains, itself at depth 0.

    What stands within one document is known from its parse. Only identifiers with several definitions lead on to what
    another definition of them contains, so rounds are made for those alone, and none without them.
    """
    if graph.nested is None:
        own = graph.nodes.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))
        return own if graph.kids is None else own.unionByName(closure(graph.kids)).groupBy("ancestor", "id").agg(F.min("depth").alias("depth"))
    if graph.repeated is None:
        return graph.nested
    met = written(graph.nested)
    again = graph.repeated.select("id")
    below = written(met.where("depth > 0").join(again.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select(F.col("ancestor").alias("at"), F.col("id").alias("to"), F.col("depth").alias("more")))
    frontier = met
    while True:
        over = frontier.where("depth > 0").join(again, "id", "left_semi").join(below, F.col("id") == F.col("at"))
        new = over.groupBy("ancestor", F.col("to").alias("id")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        known = met.select("ancestor", "id", F.col("depth").alias("known"))
        frontier = written(new.join(known, ["ancestor", "id"], "left").where("known is null or depth < known").select("ancestor", "id", "depth"))
        if frontier.isEmpty():
            return met
        met = written(met.unionByName(frontier).groupBy("ancestor", "id").agg(F.min("depth").alias("depth")))


def typed_references(graph: LinkGraph) -> DataFrame:
    """src, dst, dst_type of the reference edges; pairs may be repeated if the source knows the types."""
    if graph.typed is not None:
        return graph.typed.select("src", "dst", "dst_type")
    types = graph.nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return graph.edges.where(F.col("kind") == REFERENCE).join(types, "dst").select("src", "dst", "dst_type")


def folded(graph: LinkGraph) -> DataFrame:
    """References of an identifier and of everything below it."""
    refs = typed_references(graph)
    if graph.kids is None:
        return refs
    return descendants(graph).join(refs, F.col("id") == F.col("src")).select(F.col("ancestor").alias("src"), "dst", "dst_type").distinct()


def stage_of(graph: LinkGraph, start: str | None) -> int:
    start = start or graph.chain[0]
    if start not in graph.chain:
        raise ValueError(f"{start} is not in the chain {graph.chain}")
    return graph.chain.index(start)


def primary_levels(definitions: DataFrame) -> DataFrame:
    """path, level: the least level of an identifier in each file."""
    return definitions.groupBy("path").agg(F.min("level").alias("level"))


def roots(graph: LinkGraph, start: str) -> DataFrame:
    """Nodes of a type on the primary level of their file, which is the least level of an identifier there."""
    own = graph.nodes.where(F.col("type") == start)
    if not graph.flat:
        own = own.join(primary_levels(own), ["path", "level"])
    return own.select("id", "pos", "path", "line", "title")


def all_full(graph: LinkGraph, links: DataFrame, stage: int) -> dict[int, DataFrame]:
    """By stage, from the last but one down to ``stage``: id, full (whether every walk from it reaches the last type).

    No walk is listed. An identifier without a link to the next type is not there; it counts as not full. What links to
    the last type is full, so the last type needs no table.
    """
    last, out = len(graph.chain) - 1, {}
    for k in range(last - 1, stage - 1, -1):
        out[k] = next_full(links, graph.chain[k + 1], out.get(k + 1))
    return out


def next_full(links: DataFrame, kind: str, full: DataFrame | None) -> DataFrame:
    """id, full over its links to a type, of which ``full`` tells (None: all are)."""
    steps = links.where(F.col("dst_type") == kind)
    if full is None:
        return steps.select(F.col("src").alias("id")).distinct().withColumn("full", F.lit(True))
    ends = full.select(F.col("id").alias("dst"), "full")
    return steps.join(ends, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.min(F.coalesce("full", F.lit(False))).alias("full"))


def check_ids(graph: LinkGraph, ids: list[str]) -> None:
    """ValueError for the first of the given identifiers that is not defined; blank ones are left out."""
    asked = [x.strip() for x in ids if x.strip()]
    known = {r.id for r in graph.nodes.select(graph.name("id").alias("id")).where(F.col("id").isin(asked)).collect()} if asked else set()  # of those asked for
    for x in asked:
        if x not in known:
            raise ValueError(f"{x} is not defined")


def chosen_roots(graph: LinkGraph, start: str | None, ids: list[str]) -> DataFrame | None:
    """id of the roots that a filter names, None for an empty filter; an identifier that is undefined, or no root of the stage, is an error."""
    kind, asked = graph.chain[stage_of(graph, start)], sorted({x.strip() for x in ids if x.strip()})
    if not asked:
        return None
    own = roots(graph, kind).where(graph.name("id").isin(asked)).select("id")
    met = {r.id for r in own.select(graph.name("id").alias("id")).collect()}  # of those asked for
    for x in asked:
        check_ids(graph, [x])
        if x not in met:
            raise ValueError(f"{x} is no root of {kind}; choose the stage that it belongs to")
    return own


TALLY = ("leaves", "covered", "partly")


def matrix_status(graph: LinkGraph, start: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """id, title, path, line, leaves, covered, partly, status of every root: each leaf of its tree asks its nearest linked ancestor."""
    rows = judged(graph, folded(graph), None, start, only)
    return rows.select(graph.name("id").alias("id"), "title", "path", "line", *TALLY, "status")


def judged(graph: LinkGraph, links: DataFrame, full: dict[int, DataFrame] | None, start: str | None, only: DataFrame | None = None) -> DataFrame:
    """The rows of ``matrix_status`` by key; full: what ``all_full`` has told of the later stages, if it was asked."""
    stage = stage_of(graph, start)
    top = roots(graph, graph.chain[stage]).drop("pos")
    if only is not None:
        top = top.join(only.select("id").distinct(), "id", "left_semi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    if stage == len(graph.chain) - 1:
        return top.withColumns(dict(zip(TALLY, (one, one, none), strict=True))).withColumn("status", F.lit(COMPLETE))
    full = all_full(graph, links, stage + 1) if full is None else full
    own = next_full(typed_references(graph), graph.chain[stage + 1], full.get(stage + 1))
    if graph.kids is None:  # each root is its own leaf
        tally = top.join(own, "id", "left").withColumns(dict(zip(TALLY, (one, F.when(F.col("full"), one).otherwise(none), F.when(~F.col("full"), one).otherwise(none)), strict=True))).drop("full")
        return tally.withColumn("status", status(F.col("covered"), F.col("partly"), F.col("leaves")))
    tree = descendants(graph)
    # identifiers that contain others only in a ring of repeated ones are leaves where the ring closes
    leaves = leaves_below(graph, top.select("id"), tree)
    below_root = tree.select("ancestor", F.col("id").alias("leaf"), "depth")
    inside = tree.select(F.col("ancestor").alias("root"), F.col("id").alias("ancestor"))
    lineage = leaves.join(below_root, "leaf").join(inside, ["root", "ancestor"])
    asked = lineage.join(own.withColumnRenamed("id", "ancestor"), "ancestor").groupBy("root", "leaf").agg(F.min_by("full", "depth").alias("verdict"))
    verdicts = leaves.join(asked, ["root", "leaf"], "left").select(F.col("root").alias("id"), "verdict")
    tally = verdicts.groupBy("id").agg(F.count("*").alias("leaves"), F.count_if("verdict").alias("covered"), F.count_if(~F.col("verdict")).alias("partly"))
    out = top.join(tally, "id", "left").select("id", "title", "path", "line", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in TALLY))
    return out.withColumn("status", status(F.col("covered"), F.col("partly"), F.col("leaves")))


def leaves_below(graph: LinkGraph, top: DataFrame, tree: DataFrame) -> DataFrame:
    """root, leaf: what contains nothing below each root, or the root itself.

    Repeated identifiers can contain one another. Below such a root, a walk in document order does not enter an
    identifier again, and one whose children were all met before is a leaf.
    """
    parents = graph.kids.select(F.col("parent").alias("id")).distinct()
    under = tree.join(top.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select(F.col("ancestor").alias("root"), "id")
    plain = under.join(parents, "id", "left_anti")
    if graph.repeated is None:
        return plain.select("root", F.col("id").alias("leaf"))
    # roots over an identifier that contains others in several definitions: only there can a ring close
    odd = under.join(graph.repeated.join(parents, "id", "left_semi"), "id", "left_semi").select("root").distinct()
    order = graph.kids.select(F.col("parent").alias("id"), "child", "place.path", "place.ordinal")
    kids = under.join(odd, "root", "left_semi").join(order, "id")

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        root = own["root"].iloc[0]
        below: dict = {}
        for parent, child in own.sort_values(["path", "ordinal"])[["id", "child"]].itertuples(index=False):
            below.setdefault(parent, []).append(child)
        seen, leaves, todo = {root}, [], [(root, iter(below.get(root, ())), [0])]
        while todo:
            ident, rest, found = todo[-1]
            for child in rest:
                if child not in seen:
                    seen.add(child)
                    todo.append((child, iter(below.get(child, ())), [0]))
                    break
            else:
                todo.pop()
                if not found[0]:
                    leaves.append(ident)
                if todo:
                    todo[-1][2][0] += 1
        return pd.DataFrame({"root": [root] * len(leaves), "leaf": leaves})

    walked = kids.groupBy("root").applyInPandas(walk, "root string, leaf string")
    return plain.join(odd, "root", "left_anti").select("root", F.col("id").alias("leaf")).unionByName(walked)


def status(covered: Column, partly: Column, total: Column) -> Column:
    return F.when((covered == total) & (total > 0), COMPLETE).when((covered == 0) & (partly == 0), MISSING).otherwise(PARTIAL)


def matrix_summary(rows: DataFrame) -> DataFrame:
    """One row: totals by status and the covered share in whole percent, rounded down."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.agg(F.count("*").alias("total"), count(COMPLETE), count(PARTIAL), count(MISSING))
    return out.withColumn("coverage_percent", F.expr("if(total = 0, 0L, complete * 100 div total)"))


def matrix_paths(graph: LinkGraph, start: str | None = None) -> DataFrame:
    """id, path: every walk from a root, one type of the chain a step; a broken walk is shorter, an empty one is dropped."""
    stage = stage_of(graph, start)
    links = folded(graph).distinct()
    walks = roots(graph, graph.chain[stage]).select("id", F.col("id").alias("at"), F.array().cast("array<string>").alias("path"))
    for kind in graph.chain[stage + 1 :]:
        step = links.where(F.col("dst_type") == kind).select("src", "dst")
        longer = F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array(graph.name("dst"))))
        walks = walks.join(step, walks.at == step.src, "left").select("id", F.col("dst").alias("at"), longer.alias("path"))
    return walks.where(F.size("path") > 0).select(graph.name("id").alias("id"), "path")


def stage_ids(graph: LinkGraph, start: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """id, stage, ids: the distinct identifiers of each later type on the walks, in the order in which walks first reach them.

    Walks go by natural order, so an identifier's place is that of the least walk to it, which goes over the least walk
    to the one before. Each stage keeps that one for every root and identifier; no walk but these is made.
    """
    stage = stage_of(graph, start)
    links = folded(graph)
    top = roots(graph, graph.chain[stage]).select("id")
    at = top if only is None else top.join(only.select("id").distinct(), "id", "left_semi")
    at = at.select("id", F.col("id").alias("at"), F.array().cast("array<struct<key:array<string>,id:string>>").alias("walk"))
    out = None
    for k in range(stage + 1, len(graph.chain)):
        steps = links.where(F.col("dst_type") == graph.chain[k]).select("src", "dst")
        walk = F.concat("walk", F.array(F.struct(natural_key(graph.name("dst")).alias("key"), graph.name("dst").alias("id"))))
        met = at.join(steps, F.col("at") == F.col("src")).select("id", F.col("dst").alias("at"), walk.alias("walk"))
        at = written(met.groupBy("id", "at").agg(F.min("walk").alias("walk")))
        own = in_order(at, "id", "walk", F.element_at("walk", -1)["id"], "ids")
        own = own.select(graph.name("id").alias("id"), F.lit(graph.chain[k]).alias("stage"), "ids")
        out = own if out is None else out.unionByName(own)
    return top.sparkSession.createDataFrame([], "id string, stage string, ids string") if out is None else out


def in_order(rows: DataFrame, group: str, order: str, text: Column, out: str) -> DataFrame:
    """The texts of each group in order, joined by commas, as one text ``out``.

    Rows are dealt to ranges of group and order; each range is joined by itself, so that only a text for each range, and
    no row, meets the others of its group in one task.
    """
    dealt = written(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    nth = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    joined = lambda place, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("n"), F.col(x).alias("text")))), lambda r: r["text"]), ", ").alias(out)
    ranges = dealt.select(group, "_range", nth.alias("_nth"), text.alias("_text")).groupBy(group, "_range").agg(joined("_nth", "_text"))
    return ranges.groupBy(group).agg(joined("_range", out))


def walk_counts(graph: LinkGraph, links: DataFrame, stage: int) -> dict[int, DataFrame]:
    """By stage, from the last but one down to ``stage``: id, n of the walks that go on from it; who has none ends one."""
    out: dict[int, DataFrame] = {}
    for k in range(len(graph.chain) - 2, stage - 1, -1):
        steps = links.where(F.col("dst_type") == graph.chain[k + 1]).select("src", "dst").distinct()
        if k + 1 in out:
            steps = steps.join(out[k + 1].select(F.col("id").alias("dst"), "n"), "dst", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        else:
            steps = steps.withColumn("n", F.lit(1).cast("long"))
        out[k] = written(steps.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n")))
    return out


def paths_page(graph: LinkGraph, offset: int, limit: int, start: str | None = None) -> DataFrame:
    """n, id, path of the walks numbered offset + 1 to offset + limit, by root and then step by step in natural order.

    Walks are counted from the last type up, and a page is unranked from the counts: at each stage only the successors
    whose numbers meet the page are entered, so no walk before or behind it is made.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    stage = stage_of(graph, start)
    links = folded(graph)
    counts = walk_counts(graph, links, stage)
    empty = F.array().cast("array<string>")
    top = roots(graph, graph.chain[stage]).select("id")
    if stage not in counts:
        return top.limit(0).select(F.lit(0).cast("long").alias("n"), graph.name("id").alias("id"), empty.alias("path"))
    first = top.join(counts[stage], "id").withColumn("key", natural_key(graph.name("id")))
    # before: the walks that stand before those of this row
    at = running(first, [], ["key", "id"], "n").select("id", F.col("id").alias("at"), "n", "before", empty.alias("path"))
    page = lambda df: df.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    at = page(at)
    for k in range(stage + 1, len(graph.chain)):
        steps = links.where(F.col("dst_type") == graph.chain[k]).select("src", "dst").distinct()
        entered = at.select("id", "at", F.col("before").alias("base"), "path").join(steps, F.col("at") == F.col("src"), "left")
        if k in counts:
            entered = entered.join(counts[k].select(F.col("id").alias("dst"), "n"), "dst", "left")
            entered = entered.withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        else:
            entered = entered.withColumn("n", F.lit(1).cast("long"))
        entered = entered.withColumn("key", natural_key(graph.name("dst")))
        inside = running(entered, ["base"], ["key", "dst"], "n").withColumn("before", F.col("base") + F.col("before"))
        longer = F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array(graph.name("dst"))))
        at = page(inside.select("id", F.col("dst").alias("at"), "n", "before", longer.alias("path")))
    return at.select((F.col("before") + 1).alias("n"), graph.name("id").alias("id"), "path")


def gaps(graph: LinkGraph, start: str | None = None) -> DataFrame:
    """The rows of ``matrix_status`` that are not complete."""
    return matrix_status(graph, start).where(F.col("status") != COMPLETE)


def broken_branches(graph: LinkGraph, start: str | None = None) -> DataFrame:
    """id, branch, missing: walks that end before the last type, and roots without any walk, as text.

    Walks begin at roots with a gap and go on to identifiers that are not full only, so complete walks are never made.
    """
    stage = stage_of(graph, start)
    rest = graph.chain[stage + 1 :]
    links = folded(graph).distinct()
    full = {k: written(rows) for k, rows in all_full(graph, links, stage + 1).items()}  # read by the gaps and by each step
    walks = judged(graph, links, full, start).where(F.col("status") != COMPLETE).select("id", F.col("id").alias("at"), F.array().cast("array<string>").alias("path"))
    ended = None
    for k, kind in enumerate(rest, stage + 1):
        steps = links.where(F.col("dst_type") == kind).select("src", "dst")
        over = walks.join(steps.select(F.col("src").alias("at")).distinct(), "at", "left_anti").select("id", "path")
        ended = over if ended is None else ended.unionByName(over)
        if k not in full:
            break
        open_ends = steps.join(full[k].where("full").select(F.col("id").alias("dst")), "dst", "left_anti")
        walks = walks.join(open_ends, walks.at == open_ends.src).select("id", F.col("dst").alias("at"), F.concat("path", F.array(graph.name("dst"))).alias("path"))
    missing = F.element_at(F.array(*(F.lit(x) for x in rest)), F.size("path") + 1)
    named = ended.distinct().withColumn("id", graph.name("id"))
    return named.select("id", F.concat_ws(" -> ", F.concat(F.array("id"), "path")).alias("branch"), missing.alias("missing"))


#: Rows of a frontier up to which it goes to every task, so that the steps need not be moved in a round.
SMALL_FRONTIER = 200_000


def impact(graph: LinkGraph, start: str, depth: int = 0) -> DataFrame:
    """id, distance of everything a change can reach over all edges; depth 0 is without limit.

    A walk carries the chain stage it is at. It may enter a chain type at most one stage on (no further on, if it comes
    from outside the chain), or any stage before; a walk that began outside the chain is free until it meets the chain.
    A type that the chain has twice stands where it is last.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    stages = {t: i for i, t in enumerate(graph.chain)}
    number = lambda kind: F.coalesce(*(F.when(F.col(kind) == t, F.lit(i)) for t, i in stages.items()), F.lit(-1))
    types = graph.nodes.select("id", "type")
    if graph.typed is not None:
        typed = graph.typed
    else:
        typed = graph.edges.join(types.toDF("dst", "dst_type"), "dst").join(types.toDF("src", "src_type"), "src")
    # written once, a folder for each type that steps come from: a round reads the types that its frontier has
    kinds = lambda c: F.coalesce(c, F.lit("-"))
    steps = written(typed.select("src", "dst", number("dst_type").alias("to"), (number("src_type") >= 0).cast("int").alias("chained"), kinds("dst_type").alias("kind"), kinds("src_type").alias("from")), by="from")
    found = written(types.where(graph.name("id") == start).select("id", number("type").alias("stage"), F.lit(0).alias("distance"), kinds("type").alias("kind")))
    met = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}  # a row a type
    if not met:
        raise ValueError(f"{start} is not defined")
    frontier, far = found, 0
    while met and (not depth or far < depth):
        far += 1
        at = frontier.select("id", "stage")
        own = steps.where(F.col("from").isin(*met))
        reach = own.join(F.broadcast(at) if sum(met.values()) <= SMALL_FRONTIER else at, F.col("id") == F.col("src"))
        allowed = (F.col("to") < 0) | (F.col("stage") < 0) | (F.col("to") <= F.col("stage") + F.col("chained"))
        new = reach.where(allowed).select(F.col("dst").alias("id"), F.when(F.col("to") < 0, F.col("stage")).otherwise(F.col("to")).alias("stage"), "kind").distinct()
        frontier = written(new.join(found.select("id", "stage"), ["id", "stage"], "left_anti").select("id", "stage", F.lit(far).alias("distance"), "kind"))
        met = {r.kind: r["count"] for r in frontier.groupBy("kind").count().collect()}
        found = found.unionByName(frontier)
    return found.where(F.col("distance") > 0).groupBy("id").agg(F.min("distance").alias("distance")).select(graph.name("id").alias("id"), "distance").where(F.col("id") != start)


def subgraph(graph: LinkGraph, ids: DataFrame) -> DataFrame:
    """Edges between the given identifiers, kinds kept."""
    keep = ids.select("id").distinct()
    return graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def degrees(graph: LinkGraph) -> DataFrame:
    """id, type, path, n_refs (other identifiers it mentions), n_downstream (direct successors of both kinds) of every node.

    Each edge counts at both ends, once for its pair of identifiers, and the counts, which are numbers only, meet in one
    grouping by hash; what describes a node is joined to them.
    """
    ref, one, none = (F.col("kind") == REFERENCE).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = graph.edges.select(F.inline(F.array(F.struct(F.col("dst").alias("id"), ref.alias("r"), none.alias("d")), F.struct(F.col("src").alias("id"), none.alias("r"), one.alias("d")))))
    counts = ends.groupBy("id").agg(F.sum("r").alias("n_refs"), F.sum("d").alias("n_downstream"))
    out = graph.nodes.select("id", "type", "path").join(counts, "id", "left")
    return out.select(graph.name("id").alias("id"), "type", "path", *(F.coalesce(c, none).alias(c) for c in ("n_refs", "n_downstream")))
