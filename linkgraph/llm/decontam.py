"""Operator 7: benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its template when it is asked again with other
values. Windows of template words are hash-joined between documents and benchmark items. A document holds an item if
enough of the item's windows match and the slots agree: one value of the item always stands for one value in the text.
Held by window, a window counts if its slots have the item's own values, or agree with what each value of the item
mostly stands for in that placement; the windows in conflict drop out alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import tidy, without, written
from linkgraph.llm.omh import _ODD, mix

PIECE = regex.compile(r"\d+(?:[.,]\d+)*|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|\p{L}[\p{L}\p{M}]*|[.!?:\n%$€£°]")
#: Unit words and signs, which count as units next to a number.
UNITS = frozenset("mm cm m km g kg mg t l ml cl s sec ms min h hr hz khz mhz v w kw j kj cal kcal n pa mol usd eur gbp inch inches foot feet yard yards mile miles ounce ounces pound pounds gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres dollar dollars cent cents euro euros percent degree degrees % $ € £ °".split())
ENDS = frozenset(".!?:\n")
#: German articles and the like. A capitalised word after one, or after adjectives that follow it, is a noun.
ARTICLES = frozenset("der die das dem den des ein eine einem einen einer eines kein keine keinem keinen keiner keines im am zum zur vom beim ins ans dieser diese dieses diesem diesen jeder jede jedes jedem jeden mein meine meinem meinen meiner meines sein seine seinem seinen seiner seines ihr ihre ihrem ihren ihrer ihres unser unsere unserem unseren unserer unseres".split())
ADJECTIVE = ("e", "em", "en", "er", "es")
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Template words in a window; the share of an item's windows that must be found, and the least number (or all).
WINDOW, SHARE, LEAST = 8, 0.3, 3
#: Bits of the map of benchmark windows that documents are screened by; its size does not follow either table.
MAP_BITS = 22


def template(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """Template words, and (place, value) of each slot. Neighbouring names are one slot; signs are slots only as units.

    A capitalised word is a name, but for a noun after a German article, which is an ordinary word. The first word of a
    sentence may be a name or an ordinary one, so it is a slot of its own and never part of the name after it.
    """
    words: list[str] = []
    slots: list[tuple[int, str]] = []
    kind, first, noun = "", True, False
    for p in PIECE.findall(text):
        if p in ENDS:
            kind, first, noun = "", True, False
            continue
        last, opens, low = kind, first, p.lower()
        capital = p[0].isupper()
        if p[0].isdigit():
            kind = NUMBER
        elif low in UNITS and last == NUMBER:
            kind = UNIT
        elif capital and (opens or not noun):
            kind = NAME
        elif low[0].isalpha():
            kind = ""
        else:
            continue
        first, noun = False, low in ARTICLES and (opens or not capital) or noun and not capital and low.endswith(ADJECTIVE)
        if not kind:
            words.append(low)
        elif kind == NAME and last == NAME:
            slots[-1] = (slots[-1][0], f"{slots[-1][1]} {low}")
        else:
            slots.append((len(words), low))
            words.append(kind)
        if opens and kind == NAME:
            kind = ""
    return words, slots


def hashes(words: list[str], length: int) -> np.ndarray:
    """A 64-bit hash of every window of so many template words."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    out = np.full(n, length, np.uint64)
    for j in range(length):
        out += h[j : n + j] * _ODD[j]
    return mix(out)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, windows (how many the item has), size, pos, h, the slot values in the window and their places.

    An item of fewer words has one window, itself; null items and items without words have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, slots = template(text or "")
                size = min(window, len(words))
                if size:
                    own = hashes(words, size).view(np.int64).tolist()
                    rows += [(item, len(own), size, i, h, [v for p, v in slots if i <= p < i + size], [p for p, _ in slots if i <= p < i + size]) for i, h in enumerate(own)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "windows", "size", "ipos", "h", "islots", "iplaces"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), "item_id long, windows int, size int, ipos int, h long, islots array<string>, iplaces array<int>")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = LEAST, by_window: bool = False) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id, found and windows (counts), reworded.

    A value of the item that stands for two values in the text drops the whole placement, or with ``by_window`` only the
    windows in conflict; two values of the item may become equal. ``reworded`` tells whether some slot holds another value than the item's. Rows that share a doc_id are searched one
    by one and reported together; null or empty texts and items, and empty tables, give no rows; other columns of
    either table are ignored.
    """
    spark = docs.sparkSession
    theirs = written(item_windows(items, window))
    word = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << MAP_BITS) - 1), 6)
    # a row for each 64 bits of the map at most
    words = theirs.groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).collect()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in words:
        bitmap[r.w] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    sizes = sorted(r.size for r in theirs.select("size").distinct().collect())  # no more than ``window`` of them
    sent = spark.sparkContext.broadcast(bitmap)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = sent.value, np.uint64((1 << MAP_BITS) - 1)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if not text:
                    continue
                words, slots = template(text)
                places = np.array([p for p, _ in slots])
                for size in sizes:
                    h = hashes(words, size)
                    bit = h & mask
                    hit = np.flatnonzero(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(hit):
                        row = xxhash.xxh3_64_intdigest(text) >> 1
                        a, b = np.searchsorted(places, hit), np.searchsorted(places, hit + size)
                        rows += [(doc, row, size, int(i), int(x), [v for _, v in slots[j:k]]) for i, x, j, k in zip(hit, h[hit].view(np.int64), a, b, strict=True)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "row", "size", "pos", "h", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ours = rows.mapInArrow(tidy(screen), "doc_id long, row long, size int, pos int, h long, slots array<string>")
    met = ours.join(theirs, ["h", "size"]).where(F.size("slots") == F.size("islots")).withColumn("shift", F.col("pos") - F.col("ipos"))
    # a placement's windows, each with the mentions in it: place in the item, item value and text value
    mentions = F.arrays_zip(F.col("iplaces").alias("p"), F.col("islots").alias("a"), F.col("slots").alias("b"))
    placed = met.groupBy("doc_id", "row", "item_id", "windows", "shift").agg(F.collect_set(F.struct("ipos", mentions.alias("pairs"))).alias("met"))
    pair = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))
    placed = placed.withColumn("mentions", F.array_distinct(F.flatten("met.pairs"))).withColumn("pairs", F.array_distinct(F.transform("mentions", pair)))
    agreed = F.size(F.array_distinct("pairs.a")) == F.size("pairs")
    if by_window:
        # (mentions that say so, whether it is the item's own value, pair), the most frequent of each item value
        votes = F.transform("pairs", lambda x: F.struct(F.size(F.filter("mentions", lambda y: pair(y) == x)).alias("n"), (x["a"] == x["b"]).alias("same"), x.alias("pair")))
        best = F.transform(F.array_distinct("pairs.a"), lambda a: F.array_max(F.filter(votes, lambda v: v["pair"]["a"] == a))["pair"])
        ruled = placed.withColumn("usual", F.when(agreed, F.col("pairs")).otherwise(best))
        own = lambda w: F.forall(w["pairs"], lambda x: x["a"] == x["b"])
        kept = ruled.withColumn("met", F.filter("met", lambda w: own(w) | (F.size(F.array_except(F.transform(w["pairs"], pair), F.col("usual"))) == 0)))
    else:
        kept = placed.where(agreed)
    reworded = F.exists("met", lambda w: F.exists(w["pairs"], lambda x: x["a"] != x["b"]))
    held = kept.groupBy("doc_id", "row", "item_id", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("met.ipos")))).alias("found"), F.max(reworded).alias("reworded"))
    enough = held.where((F.col("found") >= share * F.col("windows")) & (F.col("found") >= F.least(F.lit(least), "windows")))
    return enough.groupBy("doc_id", "item_id").agg(F.max("found").alias("found"), F.max("windows").alias("windows"), F.max("reworded").alias("reworded"))


def clean(docs: DataFrame, items: DataFrame, by_window: bool = False) -> DataFrame:
    """The documents that hold no benchmark item; those with a null doc_id stay."""
    return without(docs, "doc_id", written(find(docs, items, by_window=by_window).select("doc_id").distinct()))
