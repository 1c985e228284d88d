"""The window join against a matcher that tries every placement, and items asked again with other values."""

import random
from collections import Counter

from linkgraph.llm import decontam

WORDS = "buys sells apples pears sacks of flour for each in the market town then later gives some to friend and keeps rest how many are left over after day with his her red green old new small large box cart road house by near when they go home again".split()
NAMES = "Anna Bernd Clara Otto Karla Emil Lyon Bremen Paris Oslo Rome Turin".split()


def question(rng):
    """A question as pieces: words, and slots that name a value."""
    out = []
    for _ in range(rng.randrange(25, 45)):
        r = rng.random()
        out.append(("name", rng.randrange(3)) if r < 0.12 else ("number", rng.randrange(4)) if r < 0.24 else ("word", rng.choice(WORDS)))
    return out


def asked(pieces, names, numbers):
    said = " ".join(names[v] if k == "name" else str(numbers[v]) if k == "number" else v for k, v in pieces)
    return said[0].upper() + said[1:] + "?"


def values(rng):
    return rng.sample(NAMES, 3), rng.sample(range(2, 99), 4)


def brute(docs, items, window=8):
    found = {}
    for item, text in items:
        words, slots = decontam.template(text or "")
        size = min(window, len(words))
        n = len(words) - size + 1 if size else 0
        for doc, body in docs:
            theirs, marks = decontam.template(body or "")
            hits = set()
            for shift in range(-n + 1, len(theirs)):
                at = [p for p in range(n) if 0 <= p + shift and words[p : p + size] == theirs[p + shift : p + shift + size]]
                own = {p: [(q, v) for q, v in slots if p <= q < p + size] for p in at}
                other = {p: [v for q, v in marks if p + shift <= q < p + shift + size] for p in at}
                mentions = {(q, a, b) for p in at for (q, a), b in zip(own[p], other[p], strict=True)}
                votes = Counter((a, b) for _, a, b in mentions)
                usual = {a: max((n_, a == b, b) for (x, b), n_ in votes.items() if x == a)[2] for a, _ in votes}
                for p in at:
                    pairs = [(a, b) for (_, a), b in zip(own[p], other[p], strict=True)]
                    if all(a == b for a, b in pairs) or all(usual[a] == b for a, b in pairs):
                        hits.add(p)
            if hits and len(hits) >= 0.3 * n and len(hits) >= min(3, n):
                found[doc, item] = len(hits)
    return found


def test_against_every_placement_and_recall_of_questions_asked_again(spark):
    rng = random.Random(23)
    items, docs = [], []
    pad = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40)))
    for i in range(30):
        q = question(rng)
        items.append((i, asked(q, *values(rng))))
        docs.append((100 + i, f"{pad()}. {asked(q, *values(rng))} {pad()}"))  # asked again
        if i % 3 == 0:  # one number in conflict
            names, numbers = values(rng)
            docs.append((200 + i, asked(q, names, numbers).replace(str(numbers[0]), "1000", 1)))
        if i % 4 == 0:
            docs.append((300 + i, f"{pad()} {items[-1][1]}"))  # word for word, within a sentence
    docs += [(400, None), (401, ""), (402, pad()), (100, pad())]
    items += [(90, None), (91, "Two words"), (92, "")]
    one, two = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
    got = decontam.find(spark.createDataFrame([(*d, "x") for d in docs], one), spark.createDataFrame([(*x, "y") for x in items], two), by_window=True)
    assert {(r.doc_id, r.item_id): r.found for r in got.collect()} == brute(docs, items)
    again = {r.doc_id for r in got.collect() if r.item_id == r.doc_id - 100}
    assert len(again) >= 27 and {300 + i for i in range(0, 30, 4)} <= {r.doc_id for r in got.collect()}
    assert not {400, 401, 402} & {r.doc_id for r in got.collect()}
