"""Each batch of a stream is held against what earlier batches defined."""

from linkgraph.streaming.verify import verify_stream

SCHEMA = "path string, type string, id_pattern string, text string"


def test_second_batch_knows_the_first(spark, tmp_path):
    got = {}

    def run(path, text):
        spark.createDataFrame([(path, "req", "R-{seq}", text)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        verify_stream(stream, ["req"], ["R-{seq}"], lambda df, n: got.update({n: sorted((r.kind, r.file, r.message) for r in df.collect())}), str(tmp_path / "cp")).awaitTermination()

    run("a.md", "# R-1 one\n\n# R-2 two\n\nSee R-1.\n")
    run("b.md", "# R-2 again\n\n# R-3 three\n\nSee R-1 and R-9.\n")
    assert got == {0: [], 1: [("id_duplicate", "b.md", "R-2 is defined before"), ("ref_undefined", "b.md", "R-9 is not defined")]}
