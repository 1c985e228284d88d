"""Operator 6: toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of itself and of its character n-grams, filters of several widths
slide over the whole text, each filter keeps its largest response, and a logistic layer turns those into a score. What
each word adds to each place of each filter is worked out once a worker, so scoring a text sums a few table rows. Thresholds are calibrated on rows that training did not see,
by the language that the text itself shows, and mapped to a score of 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm import langid
from linkgraph.llm.common import tidy
from linkgraph.llm.ngrams import gram_buckets, sums

#: Embedding buckets and size, filter widths, filters of each width.
BITS, DIM, WIDTHS, FILTERS = 18, 12, (1, 2, 3), 12
BUCKETS = 1 << BITS
#: Lengths of the character n-grams, and the number of training texts from which on one has an embedding.
GRAMS, LEAST_TEXTS = (4, 5, 6, 7), 8
#: Labelled texts of each class that the model is fitted and calibrated on, at most; chosen by a hash of id and text.
TRAIN_EACH = 3000
EPOCHS, BATCH, RATE, SEED, CALIBRATE_EACH = 6, 32, 0.01, 7, 10


@dataclass
class Model:
    """Embeddings, filters (window x filter) with their biases, the logistic layer, and cut-offs by language."""

    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    constant: float
    cuts: dict[str, float]
    cut: float
    languages: langid.Model


class Words(dict):
    """Word -> row of a table of what it adds at each place of each filter; row 0 stands behind the last word."""

    PLACES = sum(WIDTHS)
    LIMIT = 120_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.kernel = np.concatenate([c[k * DIM : (k + 1) * DIM] for w, c in zip(WIDTHS, model.conv, strict=True) for k in range(w)], 1)
        self.rows = np.zeros((4096, self.PLACES * FILTERS), np.float32)
        first = np.cumsum([0, *WIDTHS])[:-1]
        for k in first:  # no window begins behind the last word
            self.rows[0, k * FILTERS : (k + 1) * FILTERS] = -1e9

    def add(self, texts: list[list[str]]) -> None:
        if len(self) > self.LIMIT:
            self.clear()
        if new := [w for w in set().union(*texts) if w not in self]:
            k = len(self) + 1
            while k + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k : k + len(new)] = sums(self.model.emb, *gram_buckets(new, GRAMS, BITS), len(new)) @ self.kernel
            self.update(zip(new, range(k, k + len(new)), strict=True))

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Raw responses; a text without words has no response of any filter."""
        self.add(texts)
        lengths = np.array([len(x) for x in texts], np.int64)
        out = np.full(len(texts), self.model.constant)
        own = np.flatnonzero(lengths)
        if not len(own):
            return out
        pad = max(WIDTHS) - 1
        at = np.array([k for i in own for k in [*map(self.__getitem__, texts[i]), *[0] * pad]], np.int32)
        starts = np.cumsum(np.concatenate([[0], lengths[own] + pad]))[:-1]
        features, place = [], 0
        for bias, width in zip(self.model.bias, WIDTHS, strict=True):
            n = len(at) - width + 1
            table = lambda k: self.rows[:, (place + k) * FILTERS : (place + k + 1) * FILTERS]  # noqa: E731, B023
            x = table(0)[at[:n]]
            for k in range(1, width):
                x += table(k)[at[k : n + k]]
            place += width
            features.append(np.maximum(np.maximum.reduceat(x, starts, axis=0) + bias, 0))
        out[own] += np.concatenate(features, 1) @ self.model.weights
        return out


def train(texts: list[list[str]], labels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, float]:
    """Adam on the logistic loss. Only the word windows that won a maximum receive a gradient.

    N-grams of fewer than ``LEAST_TEXTS`` texts keep a zero embedding, so no text can be learned by its rare words.
    """
    rng = np.random.default_rng(seed)
    index = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    met = np.zeros(BUCKETS, np.int64)
    for t in texts:
        met[np.unique(gram_buckets(list(set(t)), GRAMS, BITS)[0])] += 1
    vocabulary, parts, sizes = list(index), [], [np.zeros(1, np.int64)]
    for a in range(0, len(vocabulary), 20_000):  # a part at a time, for the memory of all n-grams of all words
        some = vocabulary[a : a + 20_000]
        flat, whose = gram_buckets(some, GRAMS, BITS)
        keep = met[flat] >= LEAST_TEXTS
        flat, whose = flat[keep], whose[keep]
        parts.append(flat[np.argsort(whose, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(whose, minlength=len(some)))
    flat, sizes = np.concatenate(parts), np.concatenate(sizes)
    begin = np.cumsum(sizes) - sizes
    kept = np.unique(flat)
    slot = np.zeros(BUCKETS, np.int64)
    slot[kept] = np.arange(1, len(kept) + 1)
    flat = slot[flat]
    ids_of = [np.array([index[w] for w in t], np.int64) for t in texts]
    emb = rng.normal(0, 0.03, (len(kept) + 1, DIM)).astype(np.float32)
    emb[0] = 0
    conv = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    const = np.zeros(1, np.float32)
    params = [*conv, *bias, out, const, emb]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    pad, step = max(WIDTHS) - 1, 0

    def of_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All n-gram slots of some words, and the place in ``words`` that each belongs to."""
        n = sizes[words]
        which = np.repeat(np.arange(len(words)), n)
        return flat[np.repeat(begin[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], which

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            words, ids = np.unique(np.concatenate([np.concatenate([ids_of[i], np.zeros(pad, np.int64)]) for i in own]), return_inverse=True)
            ends = np.cumsum([len(ids_of[i]) + pad for i in own])
            starts = np.concatenate([[0], ends[:-1]])
            slots_, which = of_words(words)
            vectors = np.zeros((len(words), DIM), np.float32)
            for d in range(DIM):
                vectors[:, d] = np.bincount(which, emb[slots_, d], len(words))
            features, wins = [], []
            for w, c, b in zip(WIDTHS, conv, bias, strict=True):
                n = len(ids) - w + 1
                y = sum(((vectors @ c[k * DIM : (k + 1) * DIM])[ids[k : n + k]] for k in range(w)), np.float32(0))
                at = np.stack([s + y[s : max(s + 1, e - pad)].argmax(0) for s, e in zip(starts, ends, strict=True)])
                features.append(np.maximum(y[at, np.arange(FILTERS)] + b, 0))
                wins.append(at)
            h = np.concatenate(features, 1)
            p = 1 / (1 + np.exp(-np.clip(h @ out + const[0], -30, 30)))
            d = ((p - labels[own]) / len(own)).astype(np.float32)
            dh = np.outer(d, out) * (h > 0)
            grads_c, grads_b, g_words = [], [], np.zeros_like(vectors)
            for i, (w, c) in enumerate(zip(WIDTHS, conv, strict=True)):
                g, at = dh[:, i * FILTERS : (i + 1) * FILTERS], wins[i]
                xs = np.concatenate([vectors[ids[at + k]] for k in range(w)], 2)  # texts, filters, window
                grads_c.append(np.einsum("dfk,df->kf", xs, g))
                grads_b.append(g.sum(0))
                back = g[:, :, None] * c.T[None]
                for k in range(w):
                    np.add.at(g_words, ids[at + k].ravel(), back[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
            moved = np.flatnonzero(g_words.any(1))
            slots_, which = of_words(words[moved])
            touched, inverse = np.unique(slots_, return_inverse=True)
            g_emb = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_emb, inverse, g_words[moved][which])
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for i, g in enumerate([*grads_c, *grads_b, h.T @ d, np.array([d.sum()]), g_emb]):
                at = touched if i == len(params) - 1 else slice(None)
                m, v = moments[i]
                m[at] += 0.1 * (g - m[at])
                v[at] += 0.001 * (g * g - v[at])
                params[i][at] -= RATE * (m[at] / fix1) / (np.sqrt(v[at] / fix2) + 1e-8)
    wide = np.zeros((BUCKETS, DIM), np.float32)
    wide[kept] = emb[1:]
    return wide, conv, bias, out, float(const[0])


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut between two neighbouring responses with the best balanced accuracy; in the widest such gap."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    right = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum()) + 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gaps = np.diff(edges)
    good = np.flatnonzero((right >= right.max() - 1e-9) & (gaps > 0))
    k = good[gaps[good].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def dominant(scorer: langid.Scorer, texts: list[list[str]]) -> list[str]:
    """The language whose n-grams explain the words of each text best; words of foreign scripts count little."""
    langs = scorer.model.langs
    if not langs:
        return [langid.UNDETERMINED] * len(texts)
    return [langs[int(np.maximum(s, -5).sum(0).argmax())] if len(s) else langid.UNDETERMINED for s in scorer.scores(texts)]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, each: int = TRAIN_EACH) -> Model:
    """Fits on at most about ``each`` labelled whole texts of each class among the rows where ``learn`` holds.

    Every fourth text of the sample, by hash, is kept for the cut-offs. A language with fewer than ``CALIBRATE_EACH``
    such texts of either class uses the common cut-off. Without texts of both classes every score is 0.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(learn).select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(marked, "doc_id")
    sizes = {r.toxic: r.n for r in docs.where(learn).select("doc_id").join(marked, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    chosen = [rows.where((F.col("toxic") == k) & (pick < int(min(1.0, each / n) * 1_000_000))).select("text", "toxic", (pick % 4 == 0).alias("held")).limit(2 * each) for k, n in sorted(sizes.items())]
    sample = [r for part in chosen for r in part.collect()]  # bounded by ``each``
    sample.sort(key=lambda r: (crc32(r.text.encode()), r.toxic))
    languages = langid.fit(docs, learn, 4 * each)
    scorer = langid.Scorer(languages)
    same: dict[str, str] = {}
    texts = [[same.setdefault(w, w) for w in langid.WORD.findall(r.text.lower())] for r in sample]
    y, held = np.array([r.toxic for r in sample]), np.array([r.held for r in sample], bool)
    del sample, same
    use = [i for i in range(len(texts)) if len(texts[i]) and not held[i]]
    if len(set(y[use].tolist())) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), -30.0, {}, 0.0, languages)
    model = Model(*train([texts[i] for i in use], y[use]), {}, 0.0, languages)
    table = Words(model)
    test = [i for i in range(len(texts)) if held[i] and len(texts[i])] or use
    logits = np.concatenate([table.logits([texts[i] for i in test[a : a + 200]]) for a in range(0, len(test), 200)])
    lang = np.array(dominant(scorer, [texts[i] for i in test]))
    if len(set(y[test].tolist())) == 2:
        model.cut = best_cut(logits, y[test])
        for name in sorted(set(lang)):
            own = lang == name
            if min((y[test][own] == 1).sum(), (y[test][own] == 0).sum()) >= CALIBRATE_EACH:
                model.cuts[name] = best_cut(logits[own], y[test][own])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, lang_guess of every whole text.

    A text without words (null and empty too) has only the constant response. Repeated rows and ids are scored one by
    one; only doc_id and text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer, table = langid.Scorer(model.languages), Words(model)
        for batch in batches:
            texts = batch.column(1)
            own, langs, logits, size = [], [], [], 0

            def flush():
                logits.append(table.logits(own))
                langs.extend(dominant(scorer, own))
                own.clear()

            for x in texts:
                words = langid.WORD.findall((x.as_py() or "").lower())
                own.append(words)
                size += len(words)
                if size > 100_000:
                    flush()
                    size = 0
            flush()
            cuts = np.array([model.cuts.get(x, model.cut) for x in langs])
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(logits) - cuts, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(langs, pa.string())], names=["doc_id", "score", "predicted", "lang_guess"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, lang_guess string")
