"""Spelling variants against a comparison of all words, and edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from linkgraph.llm import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zA-ZÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and distance(w, x) == 1] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def found(spark, docs):
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, word string, n int")
    return sorted((tuple(r) for r in spelling.variants(df).collect()), key=str)


def test_against_all_pairs_of_words(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("abéÿÀ") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    weight = [1 / (1 + k) for k in range(len(base))]

    def spelt(w):
        at = rng.randrange(len(w))
        return rng.choice([w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abÉ") + w[at:], w[:at] + rng.choice("ab") + w[at + 1 :], w.upper()])

    docs = [(i, " ".join(spelt(w) for w in rng.choices(base, weight, k=300))) for i in range(40)]
    docs += [(None, docs[0][1]), (7, docs[7][1]), (50, None), (51, ""), (52, "1 2 . ß"), (53, "long" + "a" * 3000 + " " + "b" * 3000), (54, ("long" + "a" * 3000 + " ") * 3 + ("long" + "a" * 2999 + " ") * 8)]
    got = found(spark, docs)
    assert got == by_hand(docs) and any(r[1] and r[2] != r[1] for r in got)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_keys_are_those_of_deletions():
    for word in ("abcde", "aabbb", "ééaÿÿ", "aaaaa"):
        cuts = {word[:i] + word[i + 1 :] for i in range(len(word))}
        keys = spelling.deletion_keys(word)
        assert len(keys) == len(cuts) + 1
        assert set(keys.tolist()) == {int(spelling.deletion_keys(w)[0]) for w in {word, *cuts}}
    assert len(np.unique(spelling.deletion_keys("a" * 100_000))) == 2


def test_long_texts_are_cut_between_runs():
    text = "ab cde " * 50 + "x" * 40 + " é"
    assert "".join(spelling.pieces(text, 8)) == text
    assert [w for p in spelling.pieces(text, 8) for w in re.findall(spelling.RUN, p)] == re.findall(spelling.RUN, text)
