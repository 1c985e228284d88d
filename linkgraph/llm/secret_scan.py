"""Operator 5: secret scans by patterns and a battery of randomness tests.

Three patterns give the base spans. Beyond them, every long run of key characters is tested: chi-squared uniformity over
the alphabet of its inferred encoding, runs above and below the middle of that alphabet, and lag-1 serial correlation.
A string that any of these tells from a random one is no key. The others still could be ordinary text by chance, the
more easily the shorter they are. Their evidence is ``e = (combined p of the battery) * P(string | random in its
encoding) / P(string | text)``, where text draws letters as the whole corpus does, and capitals, digits and signs as
often as names in code have them. For such text its expectation is at most 1, as that of the ratio is 1 and no p exceeds
1, so ``1 / e`` is a p value of text at any length. It is held against a false-discovery bound, taken separately for
each encoding and length class over all documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import map_rows, tidy, written

#: The base patterns, the group whose length counts, and the least length, in the order of kinds.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # as long as possible from its start, so shorter runs need no match
)
KINDS = [k for k, *_ in BASE]
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", re.ASCII)
#: Encodings from the smallest alphabet up; a string has the first that holds all its characters.
HEX, LOWER, UPPER, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("decimal", DIGITS), ("hex", HEX), ("hex-upper", HEX.upper()), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("base36-upper", DIGITS + UPPER), ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
SETS = [(name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS]
#: Each test's level, the false-discovery bound, first lengths of the classes, and steps per decade of p.
LEVEL, FDR, LENGTHS, STEPS = 0.001, 0.001, (20, 32, 48, 80, 160), 20
SYMBOLS = LOWER + DIGITS + UPPER + "+/-_"
PLACE = np.full(256, len(SYMBOLS))
PLACE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
#: Shares of small letters, capitals, digits and signs in long words and names.
SMALL, CAPITAL, DIGIT, SIGN = 0.55, 0.2, 0.1, 0.15
SIZES = {name: len(alphabet) for name, alphabet in ENCODINGS}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start and then kind as listed; code points, end exclusive."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str, code: dict[str, int]) -> tuple[float, float, float]:
    """p of chi-squared uniformity (too uneven only), of runs about the middle, and of lag-1 serial correlation.

    Under randomness chi-squared over ``k`` symbols has mean ``k - 1`` and variance ``2 (k - 1) (n - 1) / n``.
    """
    x = np.array([code[c] for c in s], float)
    n, k = len(x), len(code)
    chi = (np.bincount(x.astype(int), minlength=k) ** 2).sum() * k / n - n
    p_chi = 0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2))
    high = x >= k / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        runs, mean = 1 + int((np.diff(high.astype(int)) != 0).sum()), 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    p_serial = two_sided(float((d[1:] * d[:-1]).sum() / (d * d).sum() * math.sqrt(n))) if d.any() else 0.0
    return p_chi, p_runs, p_serial


def symbols(s: str) -> np.ndarray:
    """Counts of the key characters, and last of all other bytes."""
    return np.bincount(PLACE[np.frombuffer(s.encode(), np.uint8)], minlength=len(SYMBOLS) + 1)


def text_shares(counts: np.ndarray) -> np.ndarray:
    """Shares of the key characters in text, of which the corpus counts tell those of letters, in either case together."""
    letters = counts[:26] + counts[36:62] + 1
    letters /= letters.sum()
    return np.concatenate([SMALL * letters, np.full(10, DIGIT / 10), CAPITAL * letters, np.full(4, SIGN / 4)])


def evidence(kind: str, p: float, counts, share: np.ndarray) -> int:
    """log10 of ``e`` in steps: the battery's p, and how much likelier a random string is than text with these shares."""
    ratio = float(np.dot(counts, -math.log(SIZES[kind]) - np.log(share)))
    return math.floor((ratio / math.log(10) + math.log10(p)) * STEPS)


def random_strings(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, float, np.ndarray]]:
    """start, end, encoding, combined p (Bonferroni's) and symbol counts of the strings beside the spans that pass the battery."""
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(a < m.end() and m.start() < b for a, b, _ in spans):
            continue
        letters = frozenset(s)
        name, _, code = next(x for x in SETS if letters <= x[1])
        p = min(battery(s, code))
        if p >= LEVEL / 3:
            yield m.start(), m.end(), name, min(1.0, 3 * p), symbols(s)[:-1]


FOUND = "doc_id long, base array<struct<start:int,end:int,kind:string>>, more array<struct<start:int,end:int,kind:string,p:double,counts:array<int>>>, symbols array<long>"


def tested(docs: DataFrame) -> DataFrame:
    """Base spans and the strings that pass the battery of every row; the last row of a batch has its symbol counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more, met = [], [], np.zeros(len(SYMBOLS) + 1, np.int64)
            for value in batch.column(1):
                text = value.as_py() or ""
                met += symbols(text)
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                more.append([{"start": a, "end": b, "kind": k, "p": p, "counts": n.tolist()} for a, b, k, p, n in random_strings(text, spans)])
            kinds = [f.type for f in ARROW]
            totals = [None] * (batch.num_rows - 1) + [met[:-1].tolist()] * bool(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds[1]), pa.array(more, kinds[2]), pa.array(totals, kinds[3])], names=["doc_id", "base", "more", "symbols"])

    span = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]
    ARROW = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("more", pa.list_(pa.struct([*span, ("p", pa.float64()), ("counts", pa.list_(pa.int32()))]))), ("symbols", pa.list_(pa.int64()))])  # noqa: N806
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), FOUND)


def length_class(n: int) -> int:
    return max(i for i, x in enumerate(LENGTHS) if n >= x)


def cut_offs(found: DataFrame) -> tuple[np.ndarray, dict[tuple[str, int], int]]:
    """Symbol shares of text, and for each (encoding, length class) the least step of a discovery.

    What reaches the driver: a count for each symbol, and at most a row for each encoding, length class and step.
    """
    totals = {r.k: r.n for r in found.where(F.col("symbols").isNotNull()).select(F.posexplode("symbols").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    share = text_shares(np.array([totals.get(k, 0) for k in range(len(SYMBOLS))], float))

    @F.pandas_udf("array<struct<kind:string,class:int,step:int>>")
    def judge(more):
        return more.map(lambda own: [{"kind": x["kind"], "class": length_class(x["end"] - x["start"]), "step": evidence(x["kind"], x["p"], x["counts"], share)} for x in own])

    steps = found.where(F.size("more") > 0).select(F.inline(judge("more"))).groupBy("kind", "class", "step").agg(F.count("*").alias("n"))
    cuts: dict[tuple[str, int], int] = {}
    groups: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in steps.collect():
        groups.setdefault((r.kind, r["class"]), []).append((r.step, r.n))
    for key, own in groups.items():
        total, above = sum(n for _, n in own), 0
        for step, n in sorted(own, reverse=True):
            above += n
            if 10 ** (-step / STEPS) <= FDR * above / total:
                cuts[key] = step
    return share, cuts


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans of every row: arrays of (start, end, kind), added ones of kind ``random-<encoding>``.

    A null or empty text has none. Repeated rows and ids are scanned one by one; other columns are ignored. The strings
    that pass the battery are few and written once.
    """
    found = written(tested(docs))
    share, cuts = cut_offs(found)

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def added(more):
        return more.map(lambda own: [{"start": x["start"], "end": x["end"], "kind": f"random-{x['kind']}"} for x in own if evidence(x["kind"], x["p"], x["counts"], share) >= cuts.get((x["kind"], length_class(x["end"] - x["start"])), 1 << 30)])

    return found.select("doc_id", "base", F.when(F.size("more") > 0, added("more")).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every row."""
    rank = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redacted(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    """The text with the mark in place of each run of overlapping spans."""
    if not text or not spans:
        return text
    out, at, last = [], 0, -1
    for a, b in sorted(spans):
        if a >= last:
            out += [text[at:a], mark]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The columns of documents, with every base and added span of ``text`` replaced and ``n_chars``, if there, counted anew.

    The first pass only finds the cut-offs; the second scans each text again where it stands, so no row moves. Rows
    without a span keep their ``n_chars``; a null text stays null; repeated rows and ids are treated one by one.
    """
    share, cuts = cut_offs(written(tested(docs).where((F.size("more") > 0) | F.col("symbols").isNotNull()).select("more", "symbols")))
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # a few texts are copied at a time
                batch = whole.slice(start, 1000)
                texts, sizes = [], batch.column(count).to_pylist() if count is not None else None
                for k, value in enumerate(batch.column(at)):
                    text = value.as_py()
                    spans = base_spans(text or "")
                    own = [(a, b) for a, b, _ in spans] + [(a, b) for a, b, kind, p, n in random_strings(text or "", spans) if evidence(kind, p, n, share) >= cuts.get((kind, length_class(b - a)), 1 << 30)]
                    texts.append(redacted(text, own, mark))
                    if own and sizes is not None:
                        sizes[k] = len(texts[-1])
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    columns[count] = pa.array(sizes, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, put)
