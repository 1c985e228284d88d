"""Operator 10: language of each word, span and document.

The script of a word narrows the languages that may have written it, learned character n-grams score the word for each
of those, and Viterbi with a switching penalty labels the words of a text, so mixed text falls into spans. A document
gets the language that holds most of its letters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import map_rows, tidy
from linkgraph.llm.ngrams import gram_buckets, sums
from linkgraph.llm.tokens import release

WORD = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
#: First code points of the ranges in which a script's letters stand.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
)
STARTS = [a for a, _ in SCRIPTS]
#: N-gram buckets, the weight of a word's n-grams (they overlap), the price of a switch and of a script that a
#: language does not use, in nats; a script counts as used from this share of the language's words.
BITS, WEIGHT, SWITCH, FOREIGN, USED = 15, 0.5, 8.0, 30.0, 0.01
BUCKETS, GRAMS = 1 << BITS, (1, 2, 3, 4)
#: What one pair of letters may add to a word's evidence at most, in nats; shorter words are no evidence beside others;
#: and texts with fewer letters are too short to judge their spelling.
PAIR_LIMIT, LEAST_WORD, LEAST_LETTERS = 4.0, 3, 20
#: Letters that gibberish picks from, in a script of letters and in one of syllables or words.
ALPHABET, SIGNS, SIGN_SCRIPTS = 40, 2000, ("Han", "Kana", "Hangul")
#: Documents that a model is fitted on, about; chosen by a hash of id and text.
TRAIN_DOCS = 20_000
MEMO_WORDS, CELLS, STEP, PART = 120_000, 1_000_000, 1000, 5000


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


@dataclass
class Model:
    """langs; log P(n-gram | language) by bucket; scripts that each language uses."""

    langs: list[str]
    table: np.ndarray
    scripts: dict[str, np.ndarray]

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word by language, less the mean; 0 for all where no language uses its script."""
        s = sums(self.table, *gram_buckets(words, GRAMS, BITS), len(words)) * WEIGHT
        s -= s.mean(1, keepdims=True)
        nothing = np.zeros(len(self.langs), bool)
        used = np.array([self.scripts.get(script(w), nothing) for w in words]).reshape(s.shape)
        return np.where(used.any(1, keepdims=True), s - FOREIGN * ~used, 0).astype(np.float32)

    def known(self, words: list[str]) -> np.ndarray:
        """By language, whether a word is in a script that it uses and its letters follow one another as the language's do:
        its pairs are likelier than letters drawn one by one, half of them as often as in the language and half evenly."""
        n, kinds = len(words), [script(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, n) + 2
        one, two = (gram_buckets(words, (k,), BITS)[0][:-n] for k in (1, 2))
        last = np.zeros(len(one), bool)
        last[np.cumsum(lengths) - 1] = True
        at, whose = np.flatnonzero(~last), np.repeat(np.arange(n), lengths - 1)
        even = np.repeat([0.5 / (SIGNS if x in SIGN_SCRIPTS else ALPHABET) for x in kinds], lengths)
        nothing, out = np.zeros(len(self.langs), bool), np.zeros((n, len(self.langs)), bool)
        for k in range(len(self.langs)):
            t = self.table[:, k] + np.log(len(GRAMS))  # of all grams, about a quarter are single letters and a quarter are pairs
            drawn = np.log(0.5 * np.exp(t[one]) + even)
            gain = np.clip(t[two] - drawn[at] - drawn[at + 1], -PAIR_LIMIT, PAIR_LIMIT)
            out[:, k] = np.bincount(whose, gain, n) > 0
        return out & np.array([self.scripts.get(x, nothing) for x in kinds]).reshape(out.shape)


def fit(docs: DataFrame, train: Column, sample: int = TRAIN_DOCS) -> Model:
    """Counts n-grams by language over about ``sample`` whole texts of the rows where ``train`` holds.

    The counts are summed in Spark; a row for each language and bucket reaches the driver.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    share = min(1.0, sample / max(1, rows.select("lang").count()))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, Counter()).update(WORD.findall(text.as_py().lower()))
            for lang, words in by_lang.items():
                flat, whose = gram_buckets(list(words), GRAMS, BITS)
                n, seen = np.bincount(flat, np.array([*words.values()], float)[whose], BUCKETS), Counter()
                for word, times in words.items():
                    seen[script(word)] += times
                at = np.flatnonzero(n)
                keys = [f"g{x}" for x in at] + [f"s{x}" for x in seen]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array([*n[at], *seen.values()], pa.float64())], names=["lang", "key", "n"])

    summed = rows.where(part).select("lang", "text").mapInArrow(tidy(count), "lang string, key string, n double").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(summed["lang"]))
    counts, seen = np.full((BUCKETS, len(langs)), 0.1), {}
    column = summed["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    for key, i, n in zip(summed["key"], column, summed["n"], strict=True):
        if key[0] == "g":
            counts[int(key[1:]), i] += n
        else:
            seen.setdefault(key[1:], np.zeros(len(langs)))[i] += n
    total = sum(seen.values(), np.full(len(langs), 1e-9))
    used = {k: v / total >= USED for k, v in seen.items()}
    return Model(langs, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32), {k: v for k, v in used.items() if v.any()})


class Scorer(dict):
    """Word -> row of a table of scores, and of what is known; one a worker and model."""

    def __init__(self, model: Model, judge: bool = False):
        super().__init__()
        self.model, self.judge = model, judge
        self.rows = np.zeros((1024, max(1, len(model.langs))), np.float32)
        self.known = np.zeros(self.rows.shape if judge else (0, 0), bool)

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The row of each word of each text."""
        if len(self) > MEMO_WORDS:
            self.clear()
        if new := [w for w in set().union(*texts) if w not in self]:
            k = len(self)
            while k + len(new) > len(self.rows):
                self.rows, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.known))
            for a in range(0, len(new), PART):  # a part at a time, for the memory of all n-grams of all words
                part = new[a : a + PART]
                self.rows[k + a : k + a + len(part)] = self.model.score(part)
                if self.judge:
                    self.known[k + a : k + a + len(part)] = self.model.known(part)
            self.update(zip(new, range(k, k + len(new)), strict=True))
        return [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of each word of each text."""
        return [self.rows[at] for at in self.places(texts)]


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label sequence of each text: texts of similar length advance together, a word of each at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: len(scores[i]))
    while order:
        longest = len(scores[order[-1]])
        take = max(1, min(512, CELLS // longest))
        own, order = order[-take:], order[:-take]
        lengths = np.array([len(scores[i]) for i in own])
        wide = np.zeros((longest, len(own), scores[own[0]].shape[1]), np.float32)
        for k, i in enumerate(own):
            wide[: lengths[k], k] = scores[i]
        moved, best = np.zeros(wide.shape, bool), np.zeros(wide.shape[:2], np.int64)
        state, here = wide[0].copy(), np.arange(len(own))
        first = np.searchsorted(lengths, np.arange(longest), side="right")  # texts from this one on are longer than t
        ends = np.zeros(len(own), np.int64)
        for t in range(1, longest):
            f = first[t]
            if f > first[t - 1]:
                ends[first[t - 1] : f] = state[first[t - 1] : f].argmax(1)
            s = state[f:]
            top = s.argmax(1)
            jump = s[here[: len(s)], top][:, None] - switch
            go = jump > s
            moved[t, f:], best[t, f:] = go, top
            state[f:] = np.where(go, jump, s) + wide[t, f:]
        ends[first[-1] :] = state[first[-1] :].argmax(1)
        labels = np.zeros((longest, len(own)), np.int64)
        at = ends.copy()
        for t in range(longest - 1, 0, -1):
            f = first[t]
            labels[t, f:] = at[f:]
            at[f:] = np.where(moved[t, here[f:], at[f:]], best[t, f:], at[f:])
        labels[0] = at
        for k, i in enumerate(own):
            out[i] = labels[: lengths[k], k]
    return out


def label_texts(texts: list[str | None], scorer: Scorer, spans: bool = False) -> list[tuple]:
    """lang_pred, score, n_spans and spans (empty unless asked for) of each text."""
    langs, found, places = scorer.model.langs, [], []
    for text in texts:
        text = text or ""
        if spans:
            places.append([m.span() for m in WORD.finditer(text)])
            found.append([text[i:j].lower() for i, j in places[-1]])
        else:
            found.append(WORD.findall(text.lower()))
    rows = scorer.places(found) if langs else [np.zeros(0, np.int64)] * len(found)
    scores, out = [scorer.rows[at] for at in rows], []
    for k, (words, at, s, labels) in enumerate(zip(found, rows, scores, viterbi(scores), strict=True)):
        if not len(labels):
            out.append((UNDETERMINED, 0.0, 0, []))
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        weight = size * (size >= LEAST_WORD) if size.max() >= LEAST_WORD else size
        top = int(np.lexsort((s.sum(0), np.bincount(labels, weight, len(langs))))[-1])
        known = scorer.known[at, top]
        if weight.sum() < LEAST_LETTERS:
            known = np.array([script(w) in scorer.model.scripts and scorer.model.scripts[script(w)][top] for w in words])
        marks = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        where = [{"start": places[k][i][0], "end": places[k][j - 1][1], "lang": langs[labels[i]]} for i, j in zip(marks, marks[1:], strict=False)] if spans else []
        out.append((langs[top], float((weight * known * (labels == top)).sum() / weight.sum()), len(marks) - 1, where))
    return out


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and, if asked for, the spans.

    ``score`` is the share of all letters that stand in words of the language: labelled with it, in a script that it
    uses, and spelled as its words are (words of one or two letters count only where there are no others, and spelling
    only from ``LEAST_LETTERS`` letters on). A text in a script that no language uses, or of random letters, has a score
    near 0. A text that is null or has no letter gives ``und``, score 0 and no span, and so does every text if the model
    has no language. Spans are (start, end, lang) in code points, from the first to the last word of a run. Repeated
    rows and ids are treated one by one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(sent.value, True)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                pred, share, runs, where = zip(*label_texts(batch.column(1).slice(a, STEP).to_pylist(), scorer, spans), strict=True)
                columns = [batch.column(0).slice(a, STEP), pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(runs, pa.int32())]
                names = ["doc_id", "lang_pred", "score", "n_spans"]
                if spans:
                    columns.append(pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, lang_pred string, score double, n_spans int" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(label), schema)


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose text is in a language of the model, with all their columns.

    A row goes if its text has no letter (null and empty too) or a score under ``least``. Each row is judged by itself
    where it is read, so rows that repeat a doc_id need not share a fate, a null doc_id is like any other, and no row moves.
    """
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(sent.value, True)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                stays = [pred != UNDETERMINED and share >= least for pred, share, _, _ in label_texts(part.column(place).cast(pa.string()).to_pylist(), scorer)]
                yield part.filter(pa.array(stays, pa.bool_()))

    return map_rows(docs, judge)
