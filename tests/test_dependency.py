"""Rings and reachability of declared dependencies against plain searches."""

import random
import time

import pytest

from linkgraph.operators import dependency as D


def plain_rings(depends):
    after = {}
    for f, gs in depends.items():
        for g in set(gs):
            after.setdefault(g, set()).add(f)
    out = []

    def walk(path):
        for f in sorted(after.get(path[-1], ())):
            if f == path[0]:
                out.append(path)
            elif f > path[0] and f not in path:
                walk([*path, f])

    for f in sorted(after):
        walk([f])
    return out


def plain_reach(depends, start):
    met, todo = set(), [start]
    while todo:
        for x in depends.get(todo.pop(), []):
            if x not in met:
                met.add(x)
                todo.append(x)
    return met


def some(rng, n, share):
    names = [f"f{i}" for i in range(n)]
    return {v: [w for w in names if rng.random() < share] for v in names if rng.random() < 0.9}


def test_rings_against_all_simple_walks():
    rng = random.Random(1)
    for _ in range(400):
        depends = some(rng, rng.randrange(1, 8), 0.3)
        assert D.rings(depends) == plain_rings(depends)


def test_rings_of_large_declarations_take_their_length():
    rng = random.Random(2)
    layers = {f"f{k:02}_{i:02}": [f"f{k - 1:02}_{j:02}" for j in rng.sample(range(50), 10)] if k else [] for k in range(40) for i in range(50)}
    began = time.time()
    assert D.rings(layers) == [] and time.time() - began < 1
    line = {f"g{i:05}": [f"g{i + 1:05}"] for i in range(3000)} | {"g03000": ["g02998"]}
    assert D.rings(line) == [["g02998", "g03000", "g02999"]]


def test_index_tells_only_what_is_so():
    rng = random.Random(3)
    for _ in range(300):
        depends = some(rng, rng.randrange(1, 12), 0.2)
        marks = {r[0]: r[1:] for r in D.index(depends)}
        for a, (part, first, low, ringed) in marks.items():
            met = plain_reach(depends, a)
            for b, (to, _, to_low, _) in marks.items():
                if to == part:
                    assert ringed == (b in met)
                elif first <= to <= part:
                    assert b in met
                elif to > part or to_low < low:
                    assert b not in met


@pytest.mark.parametrize("table", [False, True])
def test_reached_pairs(spark, table):
    rng = random.Random(4)
    depends = some(rng, 40, 0.05)
    names = sorted({*depends, *(g for gs in depends.values() for g in gs), "unknown"})
    pairs = [(a, b) for a in names for b in names]
    asked = spark.createDataFrame(pairs, "path string, target string")
    given = spark.createDataFrame([(f, g) for f, gs in depends.items() for g in gs] + [(None, "f1")], "path string, target string") if table else depends
    got = {(r.path, r.target) for r in D.reached(asked, given).collect()}
    assert got == {(a, b) for a, b in pairs if b in plain_reach(depends, a)}
    assert D.reached(asked, {}).collect() == []


def test_ring_table(spark):
    rng = random.Random(5)
    depends = some(rng, 14, 0.12) | {f"line{i}": [f"line{i + 1}"] for i in range(5)} | {"self": ["self"], "x1": ["x2"], "x2": ["x1"]}
    edges = spark.createDataFrame([(f, g) for f, gs in depends.items() for g in gs], "path string, target string")
    assert sorted(r.ring for r in D.ring_table(edges).collect()) == sorted(plain_rings(depends))
    assert D.ring_table(edges.limit(0)).collect() == []
