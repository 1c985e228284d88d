"""Filters, index, search order, aliases, dependencies, numbering and the grammar, case by case."""

import json
import time

import pytest
from pyspark.sql import functions as F

from linkgraph import cli
from linkgraph.functions.idgrammar import format_id, parent_id, pattern_prefix, pattern_regex, seq_of
from linkgraph.operators import graph as G
from linkgraph.operators import rules, scaffold
from linkgraph.operators import text as T
from linkgraph.sources import corpus as K
from linkgraph.sources.markdown import parse

YAML = """chain: [req, des]
files:
  - {path: docs/req.md, type: req, id_pattern: "R-{seq}"}
  - {path: docs/des.md, type: des, id_pattern: "D-{seq}", depends_on: [docs/req.md, docs/gone.md]}
"""


@pytest.fixture
def project(tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "linkgraph.yaml").write_text(YAML)
    (tmp_path / "sections.yaml").write_text("req: {required: []}\ndes:\n")
    (tmp_path / "docs/req.md").write_text("# Needs\n\n## R-1: One\nx\n\n## R-2: Two\nx\n")
    (tmp_path / "docs/des.md").write_text("# Design\n\n## D-10: A\nR-1, R-9 and R-1\n\n## D-2: B\nSee R-1.\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def corpus(spark, texts, chain=("req", "des")):
    kinds = {"req": "R-{seq}", "des": "D-{seq}", "glossary": "T-{seq}"}
    rows = [(path, kind, kinds.get(kind), text) for path, kind, text in texts]
    return K.Corpus(spark.createDataFrame(rows, "path string, type string, id_pattern string, text string"), list(chain), list(kinds.values()))


def test_filters_name_what_they_do_not_find(project, spark, capsys):
    run = lambda *argv: (cli.main([*argv], spark), capsys.readouterr())
    code, said = run("matrix", "--filter", "R-1,", "--format", "json")
    assert code == 0 and [r["id"] for r in json.loads(said.out)["rows"]] == ["R-1"]
    code, said = run("matrix", "--filter", "R-99")
    assert code == 2 and "R-99 is not defined" in said.err
    code, said = run("matrix", "--filter", "D-2")
    assert code == 2 and "D-2 is no root of req" in said.err
    code, said = run("graph", "--filter", "R-1, R-99")
    assert code == 2 and "R-99 is not defined" in said.err
    assert run("graph", "--filter", "R-1")[0] == 0


def test_list_has_references_and_successors(project, spark, capsys):
    assert cli.main(["list", "--format", "json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    entries = {e["id"]: e for e in out["entries"]}
    assert entries["D-10"]["refs"] == ["R-1", "R-9"] and entries["R-1"]["downstream"] == ["D-2", "D-10"]
    assert [e["id"] for e in out["entries"]] == ["D-2", "D-10", "R-1", "R-2"] and out["files"] == ["docs/des.md", "docs/req.md"]


def test_missing_dependency_is_a_file_that_does_not_exist(project, spark, capsys):
    assert cli.main(["verify", "docs/des.md", "--rules", "dep_order"], spark) == 1
    out = capsys.readouterr().out
    assert "docs/gone.md does not exist" in out and "docs/req.md does not exist" not in out


def test_index_keeps_repeated_definitions(spark):
    c = corpus(spark, [("a.md", "req", "## R-1: One\nR-2\n\n## R-1: Again\nR-3 R-2 R-3\n\n### R-2: Below\n")])
    rows = sorted((r.line, r.id, r.refs, r.downstream) for r in K.index(c).collect())
    assert rows == [(1, "R-1", ["R-2"], ["R-2"]), (4, "R-1", ["R-3", "R-2"], ["R-2"]), (7, "R-2", [], ["R-1"])]


def test_search_shows_headings_first(spark):
    c = corpus(spark, [("a.md", "req", "login before\n\n## R-1: Other\nlogin here\nand login\n\n## R-2: Login\ntext\n"), ("b.md", "des", "## D-1: x\nlogin\n")])
    rows = sorted(K.search(c, "LOGIN").collect(), key=lambda r: r["rank"])
    assert [(r.path, r.id, r.line, r.n_hits) for r in rows] == [("a.md", "R-2", 7, 1), ("a.md", None, 1, 1), ("a.md", "R-1", 3, 2), ("b.md", "D-1", 1, 1)]
    assert [h.text for h in rows[2].hits] == ["login here", "and login"] and rows[0].total == 4 and not rows[0].truncated
    (first,) = K.search(c, "login", limit=1).collect()
    assert (first.id, first.total, first.truncated) == ("R-2", 4, True)
    assert [r.id for r in K.search(c, "login", kind="des").collect()] == ["D-1"]


@pytest.mark.parametrize(
    ("name", "text", "found"),
    [
        ("User", "Operator (end user). More.", ["Operator", "end user"]), ("Need", "Need (wish)", ["wish"]), ("X", "a (b) c", []), ("X", "one, two (three)", []),
        ("X", f"{'w' * 31} (y)", []), ("X", "open ( only（Y）", ["open ( only", "Y"]), ("X", "機能（function）。後", ["機能", "function"]), ("X", "plain", []),
    ],
)
def test_aliases(name, text, found):
    assert rules.aliases_of(name, text) == found


def test_terms_by_first_paragraph(spark):
    c = corpus(spark, [("g.md", "glossary", "## T-1: Customer\n\nBuyer\n(client).\nSold to.\n\n## T-2: Part\nPiece (bit)\n"), ("a.md", "req", "## R-1: x\nThe client and clients, a bit.\n`client`\n")])
    assert sorted((r.line, r.message) for r in rules.term_consistency(c).collect()) == [(2, "bit should be Part"), (2, "client should be Customer")]


def test_rings_begin_at_the_first_document(spark):
    depends = {"a.md": ["c.md"], "b.md": ["a.md"], "c.md": ["b.md"], "d.md": ["d.md"], "e.md": ["a.md"]}
    assert rules.rings(depends) == [["a.md", "b.md", "c.md"], ["d.md"]]
    c = corpus(spark, [("b.md", "req", ""), ("c.md", "des", "")])
    (row,) = rules.dep_order(c, depends, missing={}).where("kind = 'dep_cycle'").collect()
    assert (row.file, row.message.split(": ")[1]) == ("b.md", "b.md -> c.md -> a.md -> b.md")


def test_numbering_counts_lines_as_the_parser_does(spark, tmp_path):
    text = "# T x\x0b\n\n## D-4: Done\n\n> ## Quoted\n\n## New\x0cpart\ny\n\n### Deep\n"
    c = corpus(spark, [("a.md", "des", text)])
    found = scaffold.assignments(c, "D-{seq}", ["a.md"], levels=(2, 3))
    assert [(r.line, r.id) for r in found.orderBy("line").collect()] == [(5, "D-5"), (7, "D-6"), (10, "D-7")]
    assert scaffold.rewritten(c, found)["a.md"] == text.replace("> ## Quoted", "> ## D-5: Quoted").replace("## New", "## D-6: New").replace("### Deep", "### D-7: Deep")


def test_numbered_by_blocks(spark):
    rows = spark.createDataFrame([("x" if i % 3 else "y", i * 7 % 101) for i in range(100)], "c string, v long")
    got = {(r.c, r.v): r.n for r in T.numbered(rows.withColumn("b", F.floor(F.col("v") / 10)), ["c"], ["b"], "v").collect()}
    for c in "xy":
        own = sorted(v for k, v in got if k == c)
        assert [got[c, v] for v in own] == list(range(1, len(own) + 1))


def test_grammar(spark):
    assert (pattern_prefix("R-{seq}"), pattern_prefix(r"R-\d+"), pattern_prefix("REQ")) == ("R-", "R-", "REQ")
    assert (format_id("R-{seq}a", 3), format_id(r"R-\d+", 3)) == ("R-3a", "R-3")
    assert not pattern_regex("{seq}-x").startswith("(?:(?<=") and pattern_regex("R-{seq}").startswith("(?:(?<=")
    ids = spark.createDataFrame([("R-12",), ("X-12",), ("R-2.5",), ("R-x",)], "id string")
    assert [(r.n, r.p) for r in ids.select(seq_of("R-{seq}", "id").alias("n"), parent_id("R-{seq}", "id").alias("p")).collect()] == [(12, None), (None, None), (2, "R-2"), (None, None)]


def test_check_ids(spark):
    graph = corpus(spark, [("a.md", "req", "## R-1: x\n")]).graph
    G.check_ids(graph, ["R-1", " ", ""])
    with pytest.raises(ValueError, match="R-2"):
        G.check_ids(graph, ["R-1", "R-2"])


def test_a_long_document_takes_its_length():
    began = time.time()
    out = parse("# A\n" + "## R-1: x\n`a` ``b` `c``\n\ntext R-1\n" * 8000, pattern_regex("R-{seq}"), [pattern_regex("R-{seq}")])
    assert len(out["headings"]) == 8001 and time.time() - began < 20
    out = parse("`" + " ` ".join("`" * (1 + i % 7) for i in range(20_000)), None, [])
    assert time.time() - began < 40 and out["n_lines"] == 1
