"""The registered queries: columns, types, folds, and a row for each document."""

import hashlib
import os
import zlib

import pytest

from linkgraph.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_wavelet_shards": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_jaccard_rtree": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_secret_battery": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_toxicity_cnn": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_order_minhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_language_spans": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(name, spark, documents):
    got = queries.queries()[name](spark, SF)
    types = dict(got.dtypes)
    assert {c: types[c] for c in types if c in COLUMNS[name]} == dict(x.split(" ") for x in COLUMNS[name].split(", "))
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(documents)
    if name == "op8_best_fit_packing":
        return
    assert len(rows) == len(documents)
    if "held_out" in types:
        folds, out = (5, 0) if name.startswith("op6") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if name.startswith("op6"):
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    if name.startswith("op10"):
        assert {r.lang_pred for r in rows} <= {d.lang for d in documents.values()} | {"und"}
        held = [r for r in rows if r.held_out]
        assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.95 * len(held)
    if name.startswith("op9"):
        ids = sorted(documents, reverse=True)
        after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
        for r in rows:
            own, other = documents[r.doc_id].text or "", documents[after[r.doc_id]].text or ""
            third = len(own) // 3
            assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - third] + other[:third]).encode()).hexdigest()
    if name.startswith("op2"):
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == start
            start += r.n_tokens
