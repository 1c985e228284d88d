"""Documents are parsed one at a time and leave as rows, so a task's memory does not follow their number or length."""

import os
import tracemalloc

import pytest

from linkgraph.functions.idgrammar import pattern_regex
from linkgraph.plans import catalog
from linkgraph.sources import corpus as K
from linkgraph.sources.markdown import Parse, parse

SCHEMA = "path string, type string, id_pattern string, text string"
SF = "/root/testdata/sf0.001"


def test_a_long_document_leaves_as_rows(spark):
    text = "## R-1: x\n\n" + "Delivers R-2, with more words than it needs.\n" * 60_000
    corpus = K.Corpus(spark.createDataFrame([("a.md", "req", "R-{seq}", text)], SCHEMA), ["req"], ["R-{seq}"])
    sizes = corpus.scan().mapInArrow(lambda batches: (b.select(["part"]) for b in batches), "part string").groupBy("part").count()
    assert {r.part: r["count"] for r in sizes.collect()} == {"document": 1, "heading": 1, "ref": 60_000, "prose": 60_002}
    assert corpus.scan().schema["prose"].dataType.typeName() == "struct"


def test_rows_are_made_one_by_one():
    text = "## R-1: x\n\n" + "Delivers R-2, with more words than it needs.\n" * 60_000
    doc = Parse(text, pattern_regex("R-{seq}"))
    tracemalloc.start()
    n = sum(1 for _ in doc.prose())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_002 and peak < 1 << 20


def test_only_lines_that_hold_a_text_are_kept(spark):
    docs = [("a.md", "req", "R-{seq}", "## R-1: x\n\nmerch\n\nnothing\n"), ("b.md", "req", "R-{seq}", "nothing\n")]
    corpus = K.Corpus(spark.createDataFrame(docs, SCHEMA), ["req"], ["R-{seq}"], ("prose",), ("merch",))
    assert [(r.path, r.line, r.text, r.owner) for r in corpus.prose.collect()] == [("a.md", 3, "merch", "R-1")]
    with pytest.raises(ValueError):
        corpus.refs  # noqa: B018


def test_plain_documents_are_parsed_as_others():
    plain = "# A\n\n## R-1: x\ntext R-2\n\n##\n### R-1.1 y ##\nR-3R-4 and R-5.\n#no heading\n####### no\n"
    regex = pattern_regex("R-{seq}")
    first, second = parse(plain, regex, [regex]), parse(plain + "\n> q\n", regex, [regex])
    assert Parse(plain, regex).plain and not Parse(plain + "\n> q\n", regex).plain
    assert [(h["level"], h["text"], h["id"], h["line"], h["has_body"]) for h in first["headings"]] == [(h["level"], h["text"], h["id"], h["line"], h["has_body"]) for h in second["headings"]]
    assert first["refs"] == second["refs"] and first["prose"] == second["prose"][:-2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["rule_id_duplicate", "containment_closure", "rule_id_gap", "rule_id_hierarchy", "rule_term_consistency", "search_body_hits"])
def test_a_query_parses_only_what_it_reads(spark, monkeypatch, name):
    made, scan = [], K.Corpus.scan
    monkeypatch.setattr(K.Corpus, "scan", lambda self: made.append(self.parts) or scan(self))
    catalog.queries()[name](spark, SF)
    assert made and all("ref" not in parts and "document" not in parts for parts in made)
