"""Keys of every encoding and length that the scan should find, planted in prose, and strings that it should leave alone."""

import random
import re

from linkgraph.llm import secret_scan

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
KINDS = {"base62": LOWER + LOWER.upper() + DIGITS, "mixed case": LOWER + LOWER.upper(), "base36": LOWER + DIGITS, "base64": LOWER + LOWER.upper() + DIGITS + "+/", "base32": LOWER.upper() + "234567", "base64url": LOWER + LOWER.upper() + DIGITS + "-_"}
LETTERS = "eeeeeeeeeeeetttttttttaaaaaaaaooooooooiiiiiiinnnnnnnsssssshhhhhhrrrrrrddddllllcccuuummmwwffggyyppbbvk"


def test_recall_by_encoding_and_length(spark):
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    prose = lambda n: " ".join(w.capitalize() if rng.random() < 0.06 else w for w in (word(rng.randrange(2, 11)) for _ in range(n)))
    rows, planted, plain = [], {}, set()
    for kind, alphabet in KINDS.items():
        for size in (20, 24, 32, 40, 64):
            for _ in range(30):
                key = "".join(rng.choice(alphabet) for _ in range(size))
                head = prose(60)
                planted[len(rows)] = (kind, size, len(head) + 1, len(head) + 1 + size)
                rows.append((len(rows), f"{head} {key} {prose(20)}"))
    for _ in range(400):  # long words, names in camel case and paths of words are no keys
        plain.add(len(rows))
        odd = rng.choice([word(rng.randrange(20, 40)), "".join(word(rng.randrange(3, 8)).capitalize() for _ in range(5)), "-".join(word(5) for _ in range(5)), "_".join(word(6) for _ in range(4)), "=" * 40, "xy" * 20])
        rows.append((len(rows), f"{prose(40)} {odd} {prose(20)}"))
    got = {r.doc_id: r.spans for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for i, (kind, size, a, b) in planted.items():
        at = [(int(x), int(y)) for x, y in re.findall(r":(\d+):(\d+)", got[i])]
        found.setdefault((kind, size), []).append(any(x <= a and b <= y for x, y in at))
    shares = {k: sum(v) / len(v) for k, v in found.items()}
    assert sum(map(sum, found.values())) >= 0.9 * len(planted), shares
    assert min(shares.values()) >= 0.6, shares
    assert sum(bool(got[i]) for i in plain) <= 0.01 * len(plain)
