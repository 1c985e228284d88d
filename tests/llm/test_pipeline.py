"""The pipeline's stages, each on its own input, and the whole of it."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkgraph.llm import common
from test_jaccard import brute

#: With names that the stages use themselves, and one that has to be quoted.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, maybe string, `_id` string, id string, cell string, label string, `a.b` string"
WORDS = {
    "en": "the house stands near river and children play there with small dogs while summer evening comes over green hills market people bread morning water letter window garden street".split(),
    "fr": "la maison est près de rivière et les enfants jouent avec petits chiens pendant que soir arrive sur collines vertes marché pain matin lettre fenêtre jardin rue toujours".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    rows = [(i, prose(rng, lang, rng.randrange(30, 90)), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    return rng, rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *"rmixcla") for i, t, lang in rows], SCHEMA)


def texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def want(rows):
    return sorted((i is None, i or 0, t or "") for i, t, _ in rows)


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(9)
    item = "A farmer named Otto sells 12 baskets of apples at 3 euros each, and later buys 5 sacks of flour for 9 euros in Bremen. How much money is left of his income?"
    spark.createDataFrame([(1, item), (2, None), (3, prose(rng, "en", 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), item


def test_language_stage_drops_foreign_scripts_and_gibberish(spark):
    rng, rows = corpus()
    rows += [(2, "again the house stands near the river", "en"), (None, prose(rng, "fr", 30), "fr"), (700, prose(rng, "en", 20_000), "en"), (701, "Yes.", "en")]
    gone = [(800, None, None), (801, "", "en"), (802, "12 345 --", "en"), (803, "Этот текст написан на языке, которого никто здесь не учил", "en"), (2, "".join(rng.choice("qxzjkvwpfhgbdmc ") for _ in range(900)), "en")]
    out = corpus_pipeline.keep_languages(spark, frame(spark, rows + gone), "")
    assert out.columns == frame(spark, rows).columns and texts(out) == want(rows)


def test_near_copies_stage_keeps_the_least_of_each_group(spark):
    rng, rows = corpus(6)
    base = prose(rng, "en", 400).split()
    for i in range(300, 340):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "en"))
    rows += [(400, None, None), (401, "", "en"), (None, " ".join(base), "en"), (402, rows[0][1], "en")]
    component = {i: c for i, _, c in brute([(i, t) for i, t, _ in rows if i is not None], 5, 80, 100)}
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, rows).columns
    assert texts(out) == want([r for r in rows if r[0] is None or component[r[0]] == r[0]])
    assert len(rows) - out.count() > 30


def test_decontamination_stage_finds_items_asked_again(spark, folder):
    path, item = folder
    rng, rows = corpus(7)
    again = item.replace("Otto", "Karla").replace("12", "31").replace("Bremen", "Lyon")
    held = [(500, f"{prose(rng, 'en', 50)}. {item} {prose(rng, 'en', 50)}", "en"), (501, f"{prose(rng, 'en', 3000)}. {again}", "en")]
    rows += [(502, None, None), (503, "", "en"), (None, item, "en")]
    out = corpus_pipeline.drop_benchmarks(spark, frame(spark, rows + held), path)
    assert out.columns == frame(spark, rows).columns and texts(out) == want(rows)


def test_secrets_stage_rewrites_texts_in_place(spark):
    rng, rows = corpus(8)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows += [(600, f"see {key} there", "en"), (601, 'password = "abc123xyz" and more', "en"), (600, f"other text with {key}", "en"), (602, None, None), (603, "", "en"), (None, "x " * 100_000 + "AKIA" + "B7" * 8, "en")]
    out = corpus_pipeline.redact_secrets(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, rows).columns
    swap = {f"see {key} there": "see [secret] there", f"other text with {key}": "other text with [secret]", 'password = "abc123xyz" and more': '[secret]" and more', rows[-1][1]: "x " * 100_000 + "[secret]"}
    assert texts(out) == want([(i, swap.get(t, t), x) for i, t, x in rows])
    assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count() == 0
    assert out.where("text is null and n_chars is not null").count() == 0


def test_empty_tables_pass_every_stage(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder[0]).collect() == []


def test_whole_pipeline(spark, folder):
    path, item = folder
    rng, rows = corpus(10)
    rows += [(900, item, "en"), (901, rows[1][1], "fr"), (902, None, None), (903, prose(rng, "en", 6000), "en")]
    frame(spark, rows).write.parquet(os.path.join(path, "documents.parquet"))
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == {i for i, _, _ in rows} - {900, 901, 902}
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_are_screened_exactly(spark, monkeypatch):
    rows = frame(spark, [(i % 50 if i % 9 else None, str(i), "en") for i in range(200)])
    drop = spark.range(0, 50, 3).toDF("x")
    for bits in (24, 2):  # a full map sends every row to the join
        monkeypatch.setattr(common, "MAP_BITS", bits)
        kept = common.without(rows, "doc_id", drop)
        assert kept.columns == rows.columns
        assert sorted(int(r.text) for r in kept.collect()) == [i for i in range(200) if not i % 9 or i % 50 % 3]
        assert {r.doc_id for r in common.among(rows, F.col("doc_id"), drop).collect()} >= set(range(0, 50, 3))
