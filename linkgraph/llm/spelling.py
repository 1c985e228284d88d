"""Operator 13: grouping of spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions; words that share one of these are candidates, and those at an
edit distance of exactly one are near. A key stands for few words (itself, and it with one character more), so no key of
the join is hot however large the vocabulary is. A word's form is its most frequent near word; roots follow the forms by
doubling, and since a form is at least twice as frequent as its word, a chain is never longer than the logarithm of the
largest count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import CRC_TABLE, crc32_sql, tidy, written

RUN = "[A-Za-zÀ-ÿ]+"
#: A word has so many characters and occurrences at least; a form is so many times as frequent as its word.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Distinct words that a task counts before it sends their counts on.
HELD = 200_000
#: An odd number: the base of the keys' polynomial, modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that end where a run does."""
    at, rest = 0, regex.compile(RUN).match
    while at < len(text):
        end = m.end() if (m := rest(text, at + size)) else at + size
        yield text[at:end]
        at = end


def occurrences(docs: DataFrame, damage: int = 0) -> DataFrame:
    """word, n over all texts: maximal runs of Latin letters, A-Z in lower case.

    With ``damage``, a run loses a character if that divides the crc32 h of ``<doc_id>:<run>``: the one at h % length.
    Each task counts before it sends, and sends whenever it holds ``HELD`` words.
    """
    find = regex.compile(RUN).findall
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in pieces(text):
                    for word, n in Counter(find(part.encode().lower().decode())).items():  # of bytes: A-Z only
                        if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                    held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(count), "word string, n long").where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(word: str) -> np.ndarray:
    """A 64-bit key of the word itself and of each of its distinct single deletions, in time that follows its length."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    power = np.cumprod(np.full(n, BASE, np.uint64)) if n else np.zeros(0, np.uint64)  # of 1, 2, ...
    terms = c * power
    before = np.concatenate([[np.uint64(0)], np.cumsum(terms)[:-1]])
    # what stands behind the deleted character moves one place down: its terms lose one factor
    moved = c[1:] * power[:-1]
    after = np.concatenate([np.cumsum(moved[::-1])[::-1], [np.uint64(0)]])
    first = np.concatenate([[True], c[1:] != c[:-1]])  # of a run of equal characters one deletion is enough
    return np.concatenate([[terms.sum(dtype=np.uint64)], (before + after)[first]])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: ids of the words (id, word) at an edit distance of exactly one, each pair in both directions, once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                keys = [deletion_keys(w) for w in part.column("word").to_pylist()]
                ids = np.repeat(part.column("id").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], names=["key", "id"])

    keys = written(words.select("id", "word").mapInArrow(tidy(emit), "key long, id long"))
    a, b = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    shared = a.join(b, "key").where("a < b").select("a", "b").distinct()
    spelled = shared.join(words.select(F.col("id").alias("a"), F.col("word").alias("x")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("y")), "b")
    near = written(spelled.where(F.levenshtein("x", "y", 1) == 1).select("a", "b"))
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """id, root of every id in (id, form): where the chain of forms ends. Each round halves what is left of a chain."""
    known = written(forms.select("id", F.col("form").alias("root")))
    while True:
        step = known.select(F.col("id").alias("root"), F.col("root").alias("on"))
        new = written(known.join(step, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        known = new.select("id", "root")
        if new.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, damage: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    Words have 5 characters and 3 occurrences at least. The form is the near word of largest n, of equal ones the
    smallest, if it is at least twice as frequent; the root is where the forms lead, the word itself if it has none.
    Null and empty texts have no words, a null doc_id counts as empty text in the checksum, repeated rows count each,
    other columns are ignored, and an empty table gives no rows.
    """
    counted = occurrences(docs, damage).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))
    words = written(written(counted).withColumn("id", F.monotonically_increasing_id()))  # numbered as they stand in a table
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("n")).alias("n"), "word", "b"))
    near = pairs.join(words.select(F.col("id").alias("b"), "word", "n"), "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = written(words.join(near, words.id == near.a, "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best")).alias("best")))
    ends = roots(joined.where(F.col("best").isNotNull()).select("id", F.col("best.b").alias("form")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("named")), "root").select("id", "named")
    return joined.join(named, "id", "left").select("word", F.col("best.word").alias("form"), F.coalesce("named", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))


def oracle() -> str:
    """The same in DuckDB's SQL: near words share a deletion at one place, or one is a deletion of the other."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
marked AS (SELECT w, n, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM counted, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pair AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.key = y.key AND x.i = y.i AND x.word <> y.word UNION SELECT word, key FROM cut WHERE key IN (SELECT word FROM words) UNION SELECT key, word FROM cut WHERE key IN (SELECT word FROM words)),
ranked AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b COLLATE "C") AS r, count(*) OVER (PARTITION BY a) AS n_near FROM pair JOIN words ON word = b),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 2 * words.n THEN b END AS form, CASE WHEN ranked.n >= 2 * words.n THEN ranked.n END AS form_n FROM words LEFT JOIN ranked ON a = words.word AND r = 1),
chain AS (SELECT word, word AS here, 0 AS k FROM formed UNION ALL SELECT chain.word, formed.form, k + 1 FROM chain JOIN formed ON formed.word = chain.here WHERE formed.form IS NOT NULL)
SELECT formed.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN (SELECT word, max_by(here, k) AS root FROM chain GROUP BY word) USING (word)"""
