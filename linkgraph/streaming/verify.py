"""Verification of documents as they arrive: each micro-batch is checked against the definitions known so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkgraph.operators import rules
from linkgraph.sources.corpus import Corpus


def verify_stream(docs: DataFrame, chain: list[str], patterns: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, only: tuple[str, ...] = ("ref_integrity", "id_uniqueness", "id_hierarchy")) -> StreamingQuery:
    """docs: a stream of path, type, id_pattern, text. The issues of each micro-batch go to ``sink`` with its number.

    IDs that a batch defines are kept below ``checkpoint`` by its number; references and duplicates are held against
    those of all earlier batches too. A batch that is run again after a failure has the same number and overwrites its
    own, so a sink that overwrites by number is exactly-once.
    """

    def check(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, corpus, path = batch.sparkSession, Corpus(batch, chain, patterns), f"{checkpoint}/definitions"
        corpus.nodes.select("id").write.mode("overwrite").parquet(f"{path}/batch={number}")
        known = spark.read.schema("id string, batch long").parquet(path).where(F.col("batch") < number).select("id").distinct()
        found = rules.verify(corpus, only=[x for x in only if x != "ref_integrity"]) if set(only) != {"ref_integrity"} else None
        more = []
        if "ref_integrity" in only:
            refs = corpus.refs.select("path", "line", "id").distinct().join(corpus.nodes.select("id"), "id", "left_anti").join(known, "id", "left_anti")
            more.append(rules.issues(refs, "ref_integrity", "ref_undefined", F.concat("id", F.lit(" is not defined"))))
        if "id_uniqueness" in only:  # the first of a batch; the rule itself gives those after it
            again = corpus.nodes.join(known, "id", "left_semi")
            more.append(rules.issues(again, "id_uniqueness", "id_duplicate", F.concat("id", F.lit(" is defined before"))))
        for own in more:
            found = own if found is None else found.unionByName(own)
        sink(found, number)

    return docs.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
