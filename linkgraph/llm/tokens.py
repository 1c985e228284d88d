"""Token ids of whole texts by a public tokenizer file, encoded chunk by chunk with a memo.

The tokenizer's own pattern never joins characters across ASCII white space, and its normalizer never composes across
it, so the ids of a text are the ids of its chunks between ASCII white space, one after another. A chunk of letters and
closing marks is two pieces of that pattern, so its ids are those of the letters, in lower case, and those of the marks.
Arrow splits texts and numbers their distinct pieces; each is looked up once a slice, and those that a worker has not
met lately are handed to the ``tokenizers`` library. A file with another front end has its texts encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose lower case is as long, and marks that make a piece of their own after letters.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?*#$%&()\"-"
PLAIN, CLOSED, LEADING = re.compile(f"[{LETTERS}]+"), f"^[{LETTERS}]+[{MARKS}]*$", f"^[{LETTERS}]+"
#: Longer pieces are not remembered; the memo is emptied when it holds so many, or so many ids.
MEMO_CHARS, MEMO_ENTRIES, MEMO_IDS = 48, 150_000, 2_000_000
#: Bytes of text that are encoded together; a longer text is encoded by itself.
SLICE_BYTES = 1 << 20

#: The front end, as a tokenizer file states it, for which all of the above holds.
SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, SPACES, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Remembers a row of ids for each piece that it has met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model, added = spec["model"], spec["added_tokens"]
        #: Whether chunks may be encoded one by one; with another front end whole texts are.
        self.by_chunk = (
            spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["continuing_subword_prefix"]
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or len(a["content"].split()) != 1 or a["content"].isalpha() for a in added)
        )
        spaces = pre_tokenizers.CharDelimiterSplit(" ")
        #: The same model behind front ends that leave out what does nothing to lower-case words, of ASCII and of others.
        self.ascii, self.light = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = spaces
        self.light.pre_tokenizer = pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.by_chunk and self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.row = {"": 0}  # stands beside white space at either end
        self.data, self.begin, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows_used, self.used = 1, 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def put(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers the pieces' ids, which stand one after another."""
        k, n = self.rows_used, len(pieces)
        while self.used + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while k + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.data[self.used : self.used + len(ids)] = ids
        self.begin[k : k + n], self.size[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.row.update(zip(pieces, range(k, k + n), strict=True))
        self.rows_used += n
        self.used += len(ids)

    def put_words(self, front, words: list[str]) -> None:
        """Remembers lower-case words: encoded together, and told apart by the tokens that end a word."""
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        ids = np.array([i for x in front.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            self.put(words, ids, np.diff(ends, prepend=0))
        else:
            self.put_single(words)

    def put_single(self, pieces: list[str]) -> None:
        got = [self.encode(x) for x in pieces]
        self.put(pieces, np.array([i for ids in got for i in ids], "<u4"), np.fromiter(map(len, got), np.int64, len(got)))

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each of some distinct pieces."""
        at = np.fromiter(map(self.row.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            ascii_words = [x for x in new if x.isascii() and x.isalpha()]
            rest = [x for x in new if not (x.isascii() and x.isalpha())]
            self.put_words(self.ascii, ascii_words)
            self.put_words(self.light, [x for x in rest if PLAIN.fullmatch(x)])
            self.put_single([x for x in rest if not PLAIN.fullmatch(x)])
            at[missing] = np.fromiter(map(self.row.__getitem__, new), np.int64, len(new))
        return at

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after another, each text closed by ``end_id``, and where each text ends."""
        if not self.by_chunk:
            own = [self.encode(x or "") + [end_id] * (end_id is not None) for x in texts.to_pylist()]
            return np.array([i for ids in own for i in ids], "<u4"), np.cumsum([len(ids) for ids in own], dtype=np.int64)
        if self.rows_used > MEMO_ENTRIES or self.used > MEMO_IDS:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        own = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, chunks, ends = own.indices.to_numpy(), own.dictionary, offsets[1:] - offsets[0]
        closed = pc.match_substring_regex(chunks, CLOSED)
        words = pc.if_else(closed, pc.utf8_lower(pc.ascii_rtrim(chunks, MARKS)), chunks).dictionary_encode()
        marks = pc.if_else(closed, pc.replace_substring_regex(chunks, LEADING, ""), "").dictionary_encode()
        known = [(self.rows(pieces), x.indices.to_numpy()) for x in (words, marks) for pieces in [x.dictionary.to_numpy(zero_copy_only=False).tolist()]]
        both = np.stack([rows[codes_] for rows, codes_ in known], 1)  # of each distinct chunk
        sizes, begin = self.size[both], self.begin[both]
        if end_id is not None:  # a chunk of one id closes each text
            at = np.append(np.arange(len(chunks)), len(chunks))
            sizes, begin = (np.concatenate([x, [[y, 0]]]) for x, y in ((sizes, 1), (begin, self.used)))
            if self.used == len(self.data):
                self.data = np.append(self.data, np.zeros_like(self.data))
            self.data[self.used] = end_id  # behind what is remembered
            codes = np.insert(codes, ends, at[-1])
            ends = ends + np.arange(1, len(ends) + 1)
        each, first = sizes[codes].ravel(), begin[codes].ravel()
        after = np.cumsum(each)
        total = int(after[-1]) if len(after) else 0
        ids = self.data[np.repeat(first - (after - each), each) + np.arange(total)]
        for x in (words, marks):
            for piece in x.dictionary.filter(pc.greater(pc.utf8_length(x.dictionary), MEMO_CHARS)).to_pylist():
                self.row.pop(piece, None)
        return ids, np.append(0, after)[2 * ends]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts (null: none) as bytes."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of some bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(a, b - a)
        a = b


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each value of an Arrow column of texts, ``end_id`` last."""
    enc = encoder(path)
    for some in slices(texts):
        ids, ends = enc.flat(some, end_id)
        yield from np.split(ids, ends[:-1])


def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Empties the memos of this worker, which other operators' tasks use next."""
    for enc in _ENCODERS.values():
        enc.clear()
