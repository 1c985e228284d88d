"""Shards as written hold every row once, within the limit, for a key that most rows share."""

from collections import Counter

from linkgraph.llm import sharding


def test_hot_key_is_written_once(spark, tmp_path):
    rows = [(i, "x" * (10 + i % 20), "hot" if i % 4 else f"k{i}") for i in range(400)] + [(400, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=600, key="source")
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=lambda r: r[0]) == rows
    sizes, pages = Counter(), set()
    for r in got:
        sizes[r.shard, r.page] += len(r.text or "")
        pages |= {r.page} if r.source == "hot" else set()
    assert max(sizes.values()) <= 600 and len(pages) > 5


def test_columns_that_clash_and_null_keys_stay(spark, tmp_path):
    rows = [(i if i % 5 else None, "y" * (i % 40) if i % 7 else None, f"s{i}", i) for i in range(120)] + [(7, "z" * 900, "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, page int")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=500)
    got = spark.read.parquet(str(tmp_path / "s"))
    order = lambda r: (r[2], r[3])
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "shard", "page").collect()), key=order) == sorted(rows, key=order)
    sizes = Counter()
    for r in got.collect():
        sizes[r._shard, r._page] += len(r.text or "")
    assert sorted(sizes.values())[-1] == 900 and sorted(sizes.values())[-2] <= 500  # a longer row is alone


def test_empty_table_writes_no_shard(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "s"))
    assert spark.read.schema("doc_id long, text string").parquet(str(tmp_path / "s")).collect() == []
