import hashlib
import random

import numpy as np
import pytest

from linkgraph.llm import decontam, langid, omh, secret_scan, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b long, score string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, 1, "x", "y") for i, t, lang in rows], SCHEMA)


def test_secrets_base_spans():
    text = 'secret: token: abcdefgh password = "abc123x" TOKEN=ab AKIA' + "A" * 16 + " " + "0af" * 8 + "g"
    assert [(k, text[a:b]) for a, b, k in secret_scan.base_spans(text)] == [("assign", 'password = "abc123x'), ("access", "AKIA" + "A" * 16), ("hex", "0af" * 8)]
    assert secret_scan.redacted(text, [(0, 6), (3, 8)], "#") == "#" + text[8:]


def test_secret_scan_adds_random_strings_only(spark):
    rng = random.Random(3)
    letters = "eeeeeeetttttaaaaoooiiinnnsshhrrdlu"  # the letters of long words are drawn as those of the other text
    words = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(40)]
    short = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(2000)]
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    rows = [(1, f"the key {key} is here", "en"), (2, " ".join(words + short), "en"), (3, "z" * 64 + " " + "yz" * 32, "en"), (4, None, None), (5, "", "en"), (1, f"the key {key} is here", "en")]
    got = secret_scan.report(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.spans) for r in got if r.spans) == [(1, "random-base62:8:72")] * 2
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got) and len(got) == 6
    out = secret_scan.redact(frame(spark, rows))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert {r.text for r in out.where("doc_id = 1").collect()} == {"the key [secret] is here"}
    assert secret_scan.report(frame(spark, rows).limit(0)).collect() == []


def test_order_minhash_chain(spark):
    texts = {9: "a b c d e f", 7: None, 5: "x", 3: "one two three four five six seven", 1: "日本語テキスト"}
    rows = [(i, t, "en") for i, t in texts.items()]
    got = {r.doc_id: r for r in omh.fingerprints(frame(spark, rows)).collect()}
    order = sorted(texts, reverse=True)
    for i, doc in enumerate(order):
        own, after = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert got[doc].n_chars == len(own) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].near_edited == omh.likeness(omh.fingerprint(own), omh.fingerprint(edited))
        assert got[doc].near_next == omh.likeness(omh.fingerprint(own), omh.fingerprint(after))
    assert omh.fingerprints(frame(spark, rows[:1])).first().near_next == 1.0
    assert omh.fingerprints(frame(spark, rows).limit(0)).collect() == []
    assert len(omh.fingerprints(frame(spark, [*rows, *rows, (None, "z", None)])).collect()) == 11


def test_order_minhash_follows_edits():
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    base = omh.fingerprint(" ".join(words))
    near = words[:]
    near[200] = "other"
    shuffled = words[200:] + words[:200]
    far = [f"v{rng.randrange(900)}" for _ in range(400)]
    likes = [omh.likeness(base, omh.fingerprint(" ".join(w))) for w in (near, shuffled, far)]
    assert likes[0] > 0.85 > likes[1] > likes[2] == 0


def test_decontamination_catches_rewording(spark):
    item = "If Anna buys 12 kg of apples and later sells 5 kg to Bernd then how much is left with Anna in the end after 3 days"
    reworded = item.replace("Anna", "Clara Meier").replace("12", "40").replace("Bernd", "Otto").replace("kg", "pounds")
    mixed = item.replace("Anna in", "Bernd in")
    clean = "Some other text that shares nothing with the benchmark but goes on and on for a while with 12 kg of words"
    items = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "tiny one", "z")], "item_id long, text string, doc_id string")
    rows = [(1, f"Before. {item}. After.", "en"), (2, f"Before. {reworded}", "en"), (3, mixed, "en"), (4, clean, "en"), (5, None, "en"), (6, "a tiny one here", "en"), (6, "a tiny one here", "en")]
    got = {(r.doc_id, r.item_id, r.reworded) for r in decontam.find(frame(spark, rows), items).collect()}
    assert got == {(1, 1, False), (2, 1, True), (6, 4, False)}
    assert sorted(r.doc_id for r in decontam.clean(frame(spark, rows), items).collect()) == [3, 4, 5]
    assert decontam.find(frame(spark, rows).limit(0), items).collect() == []
    assert decontam.find(frame(spark, rows), items.limit(0)).collect() == []


def corpus():
    rng = random.Random(1)
    parts = {"en": ["th", "ing", "er", "tion", "wh"], "de": ["sch", "ung", "ich", "ge", "ß"], "ru": ["ов", "ск", "ни"]}
    make = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 4)))
    return make, [(i, " ".join(make(lang) for _ in range(40)), lang) for i in range(120) for lang in [rng.choice(list(parts))]]


def test_language_spans(spark):
    make, rows = corpus()
    df = frame(spark, [*rows, (900, None, "en"), (901, "12 !", None), (902, "x", None)])
    model = langid.fit(df, df.doc_id % 3 != 1)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0.0)
    text = " ".join([*(make("en") for _ in range(15)), *(make("de") for _ in range(15)), *(make("ru") for _ in range(15))])
    spans = langid.predict(frame(spark, [(1, text, None)]), model, spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"] and spans[0].start == 0 and spans[-1].end == len(text)
    none = langid.fit(df.limit(0), df.doc_id > 0)
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        s = rng.normal(0, 5, (n, 3)).astype(np.float32)
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = lambda p: s[np.arange(n), p].sum() - 4 * (np.diff(p) != 0).sum()  # noqa: E731, B023
        (best,) = langid.viterbi([s], 4.0)
        assert abs(value(best) - max(value(p) for p in paths)) < 1e-3


def test_toxicity_learns_and_has_defined_edges(spark):
    rng = random.Random(4)
    bad = ["trash", "scum", "idiot"]
    rows, marks = [], []
    for i in range(240):
        toxic = i % 3 == 0
        words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 1, int(toxic)))
    df = frame(spark, [*rows, (900, None, "en"), (901, "", None)])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, df.doc_id % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    right = [got[i].predicted == t for i, _, t in marks if i % 5 == 0]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    empty = toxicity.fit(df, labels.limit(0), df.doc_id % 5 != 0)
    assert {r.predicted for r in toxicity.score(df, empty).collect()} == {0}


def test_sharding_fits_its_limit(spark):
    rows = [(i % 50 if i < 300 else 7, "x" * (i % 37), "en") for i in range(900)] + [(1000, "y" * 5000, "en"), (None, None, None)]
    got = sharding.shard(frame(spark, rows), limit=600).collect()
    assert len(got) == 902
    sizes = {}
    for r in got:
        sizes[r.shard, r.page] = sizes.get((r.shard, r.page), 0) + r.n_bytes
    for r in got:
        assert sizes[r.shard, r.page] == r.shard_bytes and (r.shard_bytes <= 600 or r.n_bytes == 5000)
    assert sharding.shard(frame(spark, rows).limit(0)).collect() == []


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>Hi &amp; bye<br>there<script>no()</script><a href='http://b'>l</a>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"))
    one = {r.warc_type: r for r in rows.where("page_id = 1").collect()}
    assert one["conversion"].content == "Hi & bye\nthere l" and "outlink: http://b" in one["metadata"].content
    assert f"derived-record: {one['conversion'].record_id}" in one["metadata"].content
    assert one["conversion"].refers_to == one["metadata"].refers_to and rows.count() == 6
    for r in rows.collect():
        head, body = r.record.split("\r\n\r\n", 1)
        assert f"Content-Length: {len(body.encode())}" in head and hashlib.sha256(body.encode()).hexdigest() in head
    warc.write_warc(rows, str(tmp_path / "w"))
    raw = spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <i>\r\nWARC-Target-URI: u\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>t",), ("junk",)], "record string")
    (r,) = warc.parse_records(raw).collect()
    assert (r.record_id, r.target_uri, r.payload, r.http_headers) == ("<i>", "u", "<p>t", "HTTP/1.1 200 OK\r\nX: y")


@pytest.mark.parametrize("text", ["", "one", "the the the the"])
def test_equal_texts_have_equal_fingerprints(text):
    assert (omh.fingerprint(text) == omh.fingerprint(text)).all() and omh.likeness(omh.fingerprint(text), omh.fingerprint(text)) == 1.0
