"""The classifier learns from up to 3,000 texts a class, so classes of 2,000 are used whole."""

import numpy as np
import pytest

from linkgraph.llm import toxicity


def test_classes_of_two_thousand_are_used_whole(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words and number ', substring(md5(string(id)), 1, 6)) AS text", "'en' AS lang")
    labels = spark.range(4000).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    seen = []

    def stop(texts, y):
        seen.append(np.bincount(y))
        raise StopIteration

    monkeypatch.setattr(toxicity, "train", stop)
    with pytest.raises(StopIteration):
        toxicity.fit(docs, labels, docs.doc_id >= 0)
    assert (seen[0] > 1400).all()  # three of four; the fourth is for the cut-offs
