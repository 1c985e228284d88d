import pytest
from pyspark.sql import functions as F

from linkgraph.functions import idgrammar as ids
from linkgraph.operators import graph as G
from linkgraph.operators import rules
from linkgraph.sources import corpus as C
from linkgraph.sources.markdown import inline_code, parse

REQ = """# Needs

## R-1: First need

### Overview
Text.

## R-2: Second need
Body.

## R-3 Third need
Body.
"""
DES = """# Design

## F-1: One
Serves R-1.

## F-2: Two
Serves R-1 and R-99.

## F-3: Three
Serves R-2, `R-3` is code.

```text R-2
R-3
```
"""
IMP = "# Code\n\n## I-1: A\nDoes F-1.\n\n## I-2: B\nDoes F-3.\n"
GLOSS = "# Words\n\n## T-1: User\nUser (end user). A person.\n"
DOCS = [("1req.md", "req", "R-{seq}", REQ), ("2des.md", "des", "F-{seq}", DES), ("3imp.md", "imp", "I-{seq}", IMP), ("4gloss.md", "glossary", "T-{seq}", GLOSS)]


def corpus(spark, docs=DOCS, chain=("req", "des", "imp")):
    return C.Corpus(spark.createDataFrame(docs, "path string, type string, id_pattern string, text string"), list(chain), [d[2] for d in docs if d[2]])


@pytest.fixture(scope="module")
def good(spark):
    return corpus(spark)


def test_id_grammar(spark):
    import re

    find = lambda p, s: re.findall(ids.pattern_regex(p), s, re.ASCII)
    assert find("R-{seq}", "see R-1.2.3. and XR-4 要件R-5") == ["R-1.2.3", "R-5"]
    assert find(r"R-\d+", "R-1.2 R-3a") == ["R-1.2"]
    for bad in ("", "{seq}{seq}", "R-("):
        with pytest.raises(ValueError):
            ids.pattern_regex(bad)
    row = spark.range(1).select(ids.seq_of("R-{seq}", F.lit("R-12.3")).alias("n"), ids.parent_id("R-{seq}", F.lit("R-1.2.3")).alias("p"), ids.parent_id("R-{seq}", F.lit("R-1")).alias("q")).first()
    assert (row.n, row.p, row.q) == (12, "R-1.2", None)
    assert sorted(["D-10", "D-2", "D-1.10", "D-1.9"], key=ids.natural_key_of) == ["D-1.9", "D-1.10", "D-2", "D-10"]


def test_markdown_blocks():
    p = parse("> ## R-1 quoted\n\n- item\n\n      code R-2\n\n~~~ R-3\nR-4\n~~~\nTitle\n===\n    lazy R-5\n", ids.pattern_regex("R-{seq}"), [ids.pattern_regex("R-{seq}")])
    assert [(h["level"], h["text"], h["id"]) for h in p["headings"]] == [(2, "R-1 quoted", "R-1"), (1, "Title", None)]
    assert [r["id"] for r in p["refs"]] == ["R-3"]
    assert inline_code("a ``b ` c`` \\` <i x=`> d `e`") == [(4, 9), (26, 27)]
    assert parse("", None, []) == {"n_lines": 0, "newline": "\n", "headings": [], "refs": [], "prose": []}
    assert parse("# A\n---\n\n## B\n", None, [])["headings"][0]["has_body"] is False


def test_coverage_and_impact(good):
    g = good.graph
    assert {r.id: r.status for r in G.matrix_status(g).collect()} == {"R-1": "partial", "R-2": "complete", "R-3": "missing"}
    paths = {(r.id, tuple(r.path)) for r in G.matrix_paths(g).collect()}
    assert paths == {("R-1", ("F-1", "I-1")), ("R-1", ("F-2",)), ("R-2", ("F-3", "I-2"))}
    assert {(r.branch, r.missing) for r in G.broken_branches(g).collect()} == {("R-1 -> F-2", "imp"), ("R-3", "des")}
    assert G.matrix_summary(G.matrix_status(g)).first().coverage_percent == 33
    assert {(r.id, r.distance) for r in G.impact(g, "R-1").collect()} == {("F-1", 1), ("F-2", 1), ("I-1", 2)}
    with pytest.raises(ValueError):
        G.impact(g, "R-77")
    assert {r.id for r in G.gaps(g, "des").collect()} == {"F-2"}


def test_impact_does_not_skip_a_stage(spark):
    docs = [("1", "req", "R-{seq}", "## R-1\nx\n## R-2\nx\n"), ("2", "des", "D-{seq}", "## D-1\nG-1\n## D-2\nR-2\n## D-3\nG-2\n"), ("3", "imp", "I-{seq}", "## I-1\nR-1 D-1 T-1\n## I-2\nG-1\n"), ("4", "guide", "G-{seq}", "## G-1\nR-1\n## G-2\nR-2 D-2\n"), ("5", "glossary", "T-{seq}", "## T-1\nx\n")]
    g = corpus(spark, docs).graph
    found = lambda i: {(r.id, r.distance) for r in G.impact(g, i).collect()}
    assert found("T-1") == {("I-1", 1)}
    assert found("R-2") == {("D-2", 1), ("G-2", 1), ("D-3", 3)}  # by way of D-2, which lets G-2 carry the design stage
    assert ("I-1", 1) not in found("R-1") and ("G-1", 1) in found("R-1")


def test_folding_of_details(spark):
    need = "## R-1\nx\n### R-1.1\nx\n### R-1.2\nx\n"
    for refs, want in (("R-1.1 R-1.2", "complete"), ("R-1.1", "partial"), ("R-1", "complete"), ("none", "missing")):
        g = corpus(spark, [("1", "req", "R-{seq}", need), ("2", "des", "D-{seq}", f"## D-1\n{refs}\n")], ("req", "des")).graph
        assert G.matrix_status(g).first().status == want


def test_nested_duplicates_end(spark):
    g = corpus(spark, [("1", "req", "X-{seq}", "## X-1\n### X-1\n## X-2\n### X-3\n#### X-2\n"), ("2", "des", "D-{seq}", "## D-1\nX-1\n")], ("req", "des")).graph
    assert {r.id for r in G.matrix_status(g).collect()} == {"X-1", "X-2"}


def test_rules(spark, good):
    specs = {"req": {"required": ["Overview"], "order": True}, "des": None, "imp": None}
    options = {"required_sections": {"specs": specs}, "dep_order": {"depends": {"2des.md": ["1req.md"], "3imp.md": ["2des.md"]}}, "id_uniqueness": {"check_sequence": True}}
    got = {(r.kind, r.file, r.line) for r in rules.verify(good, options).collect()}
    assert ("ref_undefined", "2des.md", 7) in got
    assert {k for k, *_ in got} == {"ref_undefined", "section_missing"}
    bad = corpus(spark, [("1req.md", "req", "R-{seq}", "## R-1\nThe end user sees I-1.\n### R-2.1: x\ny\n## R-4\n"), ("3imp.md", "imp", "I-{seq}", "## I-1\nR-1\n## I-1\n"), DOCS[3]], ("req", "imp"))
    options = {"required_sections": {"specs": {"req": None, "imp": None}}, "dep_order": {"depends": {"3imp.md": ["1req.md", "gone.md"]}}, "id_uniqueness": {"check_sequence": True}}
    kinds = sorted(r.kind for r in rules.verify(bad, options).collect())
    assert kinds == ["dep_inverted", "dep_missing", "hierarchy_mismatch", "id_duplicate", "id_gap", "section_empty", "section_empty", "term_alias"]
    assert {r.severity for r in rules.verify(bad, options, strict=True).collect()} == {"error"}
    with pytest.raises(ValueError):
        rules.verify(bad, options, ["nothing"])


def test_section_and_search(good):
    assert C.section(good, "F-1").first().body == "## F-1: One\nServes R-1.\n"
    rows = C.search(good, "serves r-1", limit=1).collect()
    assert len(rows) == 1 and rows[0].total == 2 and rows[0].id == "F-1"
    assert C.search(good, "r-3", fixed=True).first().id == "R-3"
