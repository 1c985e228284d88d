import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import packing, tokens, wavelet
from linkgraph.llm.queries import tokenizer_path
from linkgraph.llm.tokens import encoder

SCHEMA = "doc_id long, text string, n_tokens string, part string, length string"
TEXTS = ["", None, "Hello, World!  it's 12", "á b\xa0c\x1cd <|endoftext|> x", "日本語 テキスト 😀 naïve", "word " * 5000, "x" * 5000, "it's we'll ΑΣ", "same", "same"]


def rows():
    return [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(3, "again", "x", "y", "z"), (None, "no id", "x", "y", "z")]


def whole(text):
    return encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(encoder(tokenizer_path()).ids([text])[0], "<u4").tolist() == whole(text)


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 5000) % 300).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 9)
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for t in (0, 1, 2, 17, 299, 511, 4096):
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at) and m.occurrences(t).tolist() == at.tolist()
        assert m.count(t, 100, 900) == ((at >= 100) & (at < 900)).sum()
        assert [m.select(t, k) for k in range(0, len(at), 50)] == at[::50].tolist()


def test_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    path = str(tmp_path / "shards")
    wavelet.write_shards(df, path, tokenizer_path(), shard_tokens=64)
    got = sorted(wavelet.read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    start = 0
    texts = {i: {t} for i, t in enumerate(TEXTS)} | {None: {"no id"}}
    texts[3].add("again")
    for r in got:
        want = {(len(x := whole(t) + [2]), zlib.crc32(np.array(x, "<u4").tobytes())) for t in texts[r.doc_id]}
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want
        start += r.n_tokens
    assert wavelet.find_token(spark, path, 2).count() == 12


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert wavelet.token_table(df, tokenizer_path()).collect() == []
    assert packing.pack(df, tokenizer_path()).collect() == []


def test_packing_is_whole_and_gapless(spark):
    got = packing.pack(spark.createDataFrame(rows(), SCHEMA), tokenizer_path()).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r for r in got if r.doc_id == 5), key=lambda r: r.piece)
    assert [r.start for r in long] == [0, 2048, 4096] and sum(r.length for r in long) == 5001
    assert {r.length for r in got if r.doc_id in (0, 1)} == {1}
    assert zlib.crc32(np.array((whole(TEXTS[5]) + [0])[2048:4096], "<u4").tobytes()) == long[1].ids_crc32


def exact_bins(sizes, capacity):
    """Fewest bins by branch and bound, for a few pieces."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                rooms[i] -= sizes[k]
                go(k + 1, rooms)
                rooms[i] += sizes[k]
        rooms.append(capacity - sizes[k])
        go(k + 1, rooms)
        rooms.pop()

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    counts = {x: sizes.count(x) for x in sizes}
    left = dict(counts)
    fixed = packing.reduce_counts(left, capacity)
    assert all(sum(x) <= capacity for x, _ in fixed)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + exact_bins(rest, capacity) == exact_bins(sizes, capacity)
    used = {}
    plan = packing.patterns(counts, capacity)
    for lengths, times in plan:
        assert sum(lengths) <= capacity
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_same_texts_same_crc():
    a, b = (encoder(tokenizer_path()).ids(["same"])[0] for _ in range(2))
    assert hashlib.md5(a).digest() == hashlib.md5(b).digest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file_gives_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    enc, whole = tokens.Encoder(path), Tokenizer.from_file(path)
    assert enc.by_chunk == (name == "word_bpe_49k.json")
    texts = ["Hello, World! it's  12 o'clock\n\tnow", "", None, "  Über Straße é́ <|endoftext|> a<|endoftext|>b", "日本 x y"]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == want
    ids, ends = enc.flat(pa.array(texts, pa.string()), 7)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*w, 7] for w in want]
