"""Windows that agree with the item count, whatever other windows of the same placement say."""

import corpus_pipeline
from linkgraph.llm import decontam, queries

ITEM = "If Anna buys 12 kg of apples and later sells 5 kg to Bernd then how much is left with Anna in the end after 3 days"
TWICE = "the first basket which stands on the left holds 3 ripe apples while the second basket which stands behind it holds 5 of them"
FAR = "the ship called Anna left port before noon and the old captain who had once bought it from a trader told us while we ate that nobody but Anna ever crossed the bay"


def tables(spark, sf):
    items = [(1, ITEM), (2, TWICE), (3, FAR)]
    docs = [
        (1, ITEM.replace("Anna in", "Bernd in")), (2, TWICE.replace("3", "4").replace("5", "4")), (3, FAR.replace("but Anna", "but Bernd")),
        (4, "nothing of the kind is in here although it is as long as the others and has 4 words with 5 numbers"), (5, None),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")


def test_conflicting_windows_drop_out_alone(spark, tmp_path):
    tables(spark, tmp_path)
    got = {r.doc_id: r for r in queries.op7_template_decontamination(spark, str(tmp_path)).collect()}
    assert {i: (r.item_id, r.reworded) for i, r in got.items()} == {1: (1, False), 2: (2, True), 3: (3, False)}
    words = len(decontam.template(ITEM)[0])
    assert (got[1].found, got[1].windows) == (20 - 8 + 1, words - 8 + 1)  # the 21st word is the changed name
    left = corpus_pipeline.drop_benchmarks(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [4, 5]


def test_majority_of_a_rewording_holds(spark):
    """Anna is Clara three times and Dora once: only the windows with Dora go."""
    item = "then Anna met a friend who gave Anna some bread and after that Anna went off to the hill where Anna lives now"
    parts = item.split("Anna")
    text = "Clara".join(parts[:4]) + "Dora" + parts[4]
    docs, items = (spark.createDataFrame([(7, x)], f"{k} long, text string") for x, k in ((text, "doc_id"), (item, "item_id")))
    (r,) = decontam.find(docs, items, by_window=True).collect()
    last = len(decontam.template(item)[0]) - 3  # place of the last name
    assert r.reworded and r.found == last - 8 + 1
    assert decontam.find(docs, items).collect() == []
