"""Coverage, first walks and pages of walks on random nested projects, against walks made one by one."""

import random

import pytest

from linkgraph.functions.idgrammar import natural_key_of
from linkgraph.operators import graph as G
from linkgraph.sources import corpus as K

KINDS = {"req": "R-{seq}", "des": "D-{seq}", "imp": "I-{seq}"}


def project(rng, repeats):
    """Documents with nested headings that mention what stands in the stage before; some identifiers are defined again."""
    docs, known = [], {"req": [], "des": [], "imp": []}
    for kind, before in (("req", None), ("des", "req"), ("imp", "des")):
        for d in range(3):
            lines, level = ["# Title"], 2
            for k in range(rng.randrange(1, 6)):
                level = rng.randrange(2, min(6, level + 2) + 1) if k else 2
                if repeats and known[kind] and rng.random() < repeats:
                    ident = rng.choice(known[kind])
                else:
                    ident = f"{KINDS[kind][0]}-{d * 10 + k + 1}"
                known[kind].append(ident)
                lines.append(f"{'#' * level} {ident}: t")
                for _ in range(rng.randrange(0, 3)):
                    lines.append("See " + rng.choice(known[before] if before and known[before] else ["X-1"]) + ".")
                if rng.random() < 0.2:
                    lines.append("And " + rng.choice(known[kind]) + ".")
                lines.append("")
            docs.append((f"{kind}{d}.md", kind, KINDS[kind], "\n".join(lines) + "\n"))
    return docs


class ByHand:
    def __init__(self, docs, chain):
        self.chain, self.node, self.kids, self.ref = chain, {}, {}, {}
        heads = []
        for path, kind, _, text in sorted(docs):
            stack = []
            for no, line in enumerate(text.split("\n"), 1):
                if line.startswith("##"):
                    level, ident = len(line.split()[0]), line.split()[1].rstrip(":")
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    self.node.setdefault(ident, (kind, path, no, level))
                    if stack and stack[-1][1] != ident and ident not in self.kids.setdefault(stack[-1][1], []):
                        self.kids[stack[-1][1]].append(ident)
                    stack.append((level, ident))
                elif line[:4] in ("See ", "And ") and stack:
                    heads.append((line[4:-1], stack[-1][1]))
        for src, dst in heads:
            if src in self.node and src != dst:
                self.ref.setdefault(src, set()).add(dst)

    def below(self, ident):
        seen, out, todo = {ident}, [], [ident]
        while todo:
            for k in self.kids.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    out.append(k)
                    todo.append(k)
        return out

    def own(self, ident, kind):
        return sorted((x for x in self.ref.get(ident, ()) if self.node[x][0] == kind), key=natural_key_of)

    def folded(self, ident, kind):
        return sorted({x for f in [ident, *self.below(ident)] for x in self.own(f, kind)}, key=natural_key_of)

    def walks(self, starts, stage):
        out = []

        def walk(ident, k, path):
            following = self.folded(ident, self.chain[k]) if k < len(self.chain) else []
            if not following:
                out.append(path)
            for x in following:
                walk(x, k + 1, [*path, x])

        for x in starts:
            walk(x, stage + 2, [x])
        return out

    def leaves(self, ident, seen):
        seen.add(ident)
        out = [x for k in self.kids.get(ident, []) if k not in seen for x in self.leaves(k, seen)]
        return out or [ident]

    def depth(self, root):
        found, todo, d = {root: 0}, [root], 0
        while todo:
            d += 1
            todo = [k for x in todo for k in self.kids.get(x, []) if k not in found and not found.update({k: d})]
        return found

    def matrix(self, stage=0):
        level = {}
        mine = {i: v for i, v in self.node.items() if v[0] == self.chain[stage]}
        for _, path, _, lv in mine.values():
            level[path] = min(level.get(path, 9), lv)
        rows, paths, stages = {}, [], {}
        for root in sorted((i for i, v in mine.items() if v[3] == level[v[1]]), key=natural_key_of):
            own = self.walks(self.folded(root, self.chain[stage + 1]), stage)
            paths += [(root, p) for p in own]
            for k in range(len(self.chain) - stage - 1):
                if ids := list(dict.fromkeys(p[k] for p in own if len(p) > k)):
                    stages[root, self.chain[stage + 1 + k]] = ", ".join(ids)
            covered = partly = 0
            found = self.leaves(root, set())
            for leaf in found:
                line = [(d, x) for x, d in self.depth_up(leaf).items() if x in {root, *self.below(root)}]
                for _, x in sorted(line):
                    ends = self.walks(self.own(x, self.chain[stage + 1]), stage)
                    if ends:
                        full = all(len(p) == len(self.chain) - stage - 1 for p in ends)
                        covered, partly = covered + full, partly + (not full)
                        break
            rows[root] = (len(found), covered, partly)
        return rows, paths, stages

    def depth_up(self, leaf):
        return {x: self.depth(x)[leaf] for x in self.node if leaf in self.depth(x)}


@pytest.mark.parametrize(("seed", "repeats"), [(1, 0), (2, 0), (3, 0.15)])
def test_against_walks_one_by_one(spark, seed, repeats):
    docs = project(random.Random(seed), repeats)
    corpus = K.Corpus(spark.createDataFrame(docs, "path string, type string, id_pattern string, text string"), [*KINDS], [*KINDS.values()])
    graph, hand = corpus.graph, ByHand(docs, [*KINDS])
    assert {(r.ancestor, r.id): r.depth for r in G.descendants(graph).collect()} == {(x, y): d for x in hand.node for y, d in hand.depth(x).items()}
    rows, paths, stages = hand.matrix()
    if not repeats:
        assert {r.id: (r.leaves, r.covered, r.partly) for r in G.matrix_status(graph).collect()} == rows
    else:  # where repeated identifiers make several ways up, which one is nearest is a matter of order
        assert {r.id: r.leaves for r in G.matrix_status(graph).collect()} == {i: v[0] for i, v in rows.items()}
    assert {(r.id, r.stage): r.ids for r in G.stage_ids(graph).collect()} == stages
    pages = [r for at in range(0, len(paths) + 4, 4) for r in sorted(G.paths_page(graph, at, 4).collect())]
    assert [(r.id, list(r.path)) for r in pages] == paths and [r.n for r in pages] == list(range(1, len(paths) + 1))
    assert sorted((r.id, list(r.path)) for r in G.matrix_paths(graph).collect()) == sorted(paths)


def test_pages_have_bounds(spark):
    docs = [("a.md", "req", "R-{seq}", "## R-1: x\n"), ("b.md", "des", "D-{seq}", "## D-2: y\nR-1\n")]
    graph = K.Corpus(spark.createDataFrame(docs, "path string, type string, id_pattern string, text string"), ["req", "des"], ["R-{seq}", "D-{seq}"]).graph
    assert [tuple(r) for r in G.paths_page(graph, 0, 5).collect()] == [(1, "R-1", ["D-2"])]
    assert G.paths_page(graph, 1, 5).collect() == [] and G.paths_page(graph, 0, 5, "des").collect() == []
    with pytest.raises(ValueError, match="negative"):
        G.paths_page(graph, -1, 5)


def test_numbering_follows_the_order_of_names(spark):
    from linkgraph.operators import scaffold

    docs = [(f"{f}.md", "req", "R-{seq}", f"# {f}\n\n## R-4: x\n\n## {f}1\n\n## {f}2\n") for f in "abc"]
    corpus = K.Corpus(spark.createDataFrame(docs, "path string, type string, id_pattern string, text string"), ["req"], ["R-{seq}"])
    got = {r.text: r.id for r in scaffold.assignments(corpus, "R-{seq}", ["c.md", "a.md", "c.md"]).collect()}
    assert got == {"c1": "R-5", "c2": "R-6", "a1": "R-7", "a2": "R-8"}
