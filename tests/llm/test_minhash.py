"""MinHash near-duplicates against a comparison of all sets, the posterior against its definition, and edges."""

import random

import numpy as np

from linkgraph.llm import minhash

COLUMNS = "doc_id long, text string, n long, key string, cell long"


def shingled(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_hand(rows, k, num, den):
    sets = [(d, shingled(t, k)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted(((d, len(x), None if d is None else top(d), d is None or top(d) == d) for d, x in sets), key=str)


def found(spark, rows, k=5, num=85, den=100):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS)
    return sorted((tuple(r) for r in minhash.join(df, k, num, den).collect()), key=str)


def documents(rng):
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text) + (f" {shared}" if g % 3 == 0 else ""))
    chain = [rng.choice(words) for _ in range(150)]
    for step in range(8):  # each near the one before it only
        rows.append(" ".join(chain))
        chain = [*chain[5:], *(f"n{step}{j}" for j in range(5))]
    return rows


def test_against_all_pairs(spark):
    rng = random.Random(11)
    texts = documents(rng)
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    rows += [(300, rows[0][1].upper()), (301, None), (302, ""), (303, " \n"), (304, "two words"), (305, "Two  WORDS"), (None, rows[0][1]), (3, rows[20][1]), (7, rows[7][1]), (306, "long " * 50_000), (307, "Long " * 60_000)]
    assert found(spark, rows) == by_hand(rows, 5, 85, 100)
    assert found(spark, rows, 5, 80, 100) == by_hand(rows, 5, 80, 100)


def test_blocks_and_second_rounds(spark, monkeypatch):
    """Tiny blocks: groups are spread over many, and two groups just below the threshold share every band."""
    rng = random.Random(12)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"v{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(300)]
    other = base[:262] + [rng.choice(words) for _ in range(38)]
    rows = []
    for text in (base, other):
        for _ in range(20):
            near = list(text)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    assert found(spark, rows, 5, 80, 100) == by_hand(rows, 5, 80, 100)
    assert found(spark, rows) == by_hand(rows, 5, 85, 100)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(4, None), (None, None)]) == by_hand([(4, None), (None, None)], 5, 85, 100)


def test_dedupe(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, "other words stand in here"), (None, "a b c d e f g"), (10, None)]
    left = minhash.dedupe(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["10", "2", "9", "None"] and left[0].cell == 2


def test_posterior():
    """Of the last pruned count the posterior chance is below the miss probability, of the next one it is not."""
    t, x = 0.85, np.linspace(0, 1, 200_001)
    for k, least in enumerate(minhash.least_matches(85, 100)):
        n = (k + 1) * minhash.BATCH

        def chance(m):
            log = m * np.log(np.maximum(x, 1e-300)) + (n - m) * np.log(np.maximum(1 - x, 1e-300))  # noqa: B023
            density = np.exp(log - log.max())
            return density[x >= t].sum() / density.sum()

        assert chance(least) >= minhash.MISS * 0.9
        assert least == 0 or chance(least - 1) < minhash.MISS * 1.1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    other = np.concatenate([own[:3000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])
    a, b = (np.frombuffer(minhash.signature(np.unique(x)), np.uint16) for x in (own, other))
    assert abs((a == b).mean() - 0.6) < 0.13
    assert len(set(minhash.bands(own))) == minhash.BANDS
