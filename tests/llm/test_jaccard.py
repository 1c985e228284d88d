import random
import re

from linkgraph.llm import jaccard


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                if x != y:
                    label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    return {(i, len(sets[i]), label[i]) for i in sets}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 20, 60, 90]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "ONE"), (1005, "é  a"), (1006, "É a"), (1007, "x\x0by\x0cz\x1cw\xa0v u"), (1008, "x y z\x1cw\xa0v U"), (1009, "x y z w v u")]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(passage + w if rng.random() < 0.2 else w)))
    return rows


def test_against_brute_force(spark):
    for seed, (k, num, den) in enumerate([(4, 85, 100), (5, 80, 100)]):
        rows = corpus(seed, 250)
        got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
        assert got == brute(rows, k, num, den)


def test_large_entries_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(7, 150)
    got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_empty_table_and_dedupe(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n string, label string")
    assert jaccard.join(df).collect() == []
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, None, "z"), (None, "q", "w"), (4, "A b c d e f g", "v")]
    kept = jaccard.dedupe(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}


def test_null_texts_beside_others_of_their_id_link_nothing(spark):
    base = " ".join(f"w{i}" for i in range(40))
    near = " ".join(f"w{i}" for i in range(34)) + " x y z u v w"  # a candidate, but no link
    rows = [(1, base), (1, None), (2, near), (2, None)]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == {(1, 1), (2, 2)}


def test_large_group_of_near_copies_beside_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(5000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*passage, *(word() for _ in range(rng.randrange(5, 60)))])) for i in range(120)]
    got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_an_id_with_several_texts_ties_their_groups(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, b), (5, a), (5, b), (6, "c d e f g")]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 6)}


def test_bounds_never_fall_below_the_overlap():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 5000)))) for _ in range(2)]
        rows = jaccard.Points(np.arange(2), np.array([len(x) for x in sets]), np.arange(2), [jaccard.point(x) for x in sets])
        overlap = len(np.intersect1d(*sets))
        for dims in (128, int(rows.groups.min())):
            assert np.minimum(*rows.folded(np.arange(2), dims).astype(int)).sum() >= overlap


def test_groups_just_below_the_threshold_of_one_another(spark, monkeypatch):
    """They share all entries, and no pair between them is a link, so the second round has them all."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(12)
    words = [f"v{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(300)]
    other = base[:262] + [rng.choice(words) for _ in range(38)]
    rows = []
    for text in (base, other):
        for _ in range(20):
            near = list(text)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    for k, num in ((5, 80), (4, 85)):
        got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()}
        assert got == brute(rows, k, num, 100)
