"""The prefix trie against one that is built node by node, and its edges."""

import hashlib
import random
import zlib

import pytest

from linkgraph.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, digest string, depth int"


def by_hand(rows, rebuild):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, (role, text)))
    told = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    if rebuild:
        skip = {c: zlib.crc32(str(c).encode()) % 6 for c in told}
        told = {c: told.get(c - c % 100, [])[: skip[c]] + v[skip[c] :] for c, v in told.items()}
    members = {}
    for c, v in told.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(x[:-1] == k for x in members if x)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(own) if len(told[c]) == len(key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, rebuild):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], COLUMNS)
    return sorted((tuple(r) for r in trie.trie(df, rebuild).collect()), key=str)


@pytest.mark.parametrize("rebuild", [False, True])
def test_against_a_trie_by_hand(spark, rebuild):
    rng = random.Random(12)
    rows = []
    for c in [*range(0, 40), *range(190, 230), 305, 307, 409, 1000, 1001]:
        n = rng.randrange(1, 9)
        for t in range(n):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yes", "né ü 😀", "", None])))
    rows += [(None, 1, "user", "hi"), (5, 3, "user", "hi"), (5, 3, "user", "hi"), (1000, 50, "user", "x" * 100_000)]
    rng.shuffle(rows)
    assert found(spark, rows, rebuild) == by_hand(rows, rebuild)


def test_a_long_conversation_and_many_copies(spark):
    rows = [(1, t, "u", "same") for t in range(300)] + [(c, t, "u", f"{t}") for c in range(100, 400) for t in range(3)]
    assert found(spark, rows, False) == by_hand(rows, False)


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 20)
    rows = [(c * 37, 0, "u", "a") for c in range(500)]
    assert found(spark, rows, False) == by_hand(rows, False)


def test_empty(spark):
    assert found(spark, [], True) == []
    assert found(spark, [(None, None, None, None)], True) == []
    assert found(spark, [(5, None, None, None)], True) == by_hand([(5, None, None, None)], True)
