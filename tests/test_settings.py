"""Configurations with faults name the line; merged settings are read; files are told by their declarations."""

import os

import pytest

from linkgraph.sources import config, scan

HEAD = 'chain: [req]\nfiles:\n  - {path: a.md, type: req, id_pattern: "R-{seq}"}\n'


def load(tmp_path, text, **more):
    (tmp_path / "linkgraph.yaml").write_text(text)
    return config.load(str(tmp_path / "linkgraph.yaml"), **more)


@pytest.mark.parametrize(
    ("text", "line", "what"),
    [
        (HEAD + "rules:\n  ref_integrity:\n    enable: false\n", 6, "enable"), (HEAD + "rules:\n  ref_integrity:\n    enabled: true\n  term_consistency:\n    enable: true\n", 8, "enable"),
        (HEAD + "defaults: &d\n  enable: false\nrules:\n  ref_integrity:\n    <<: *d\n", 5, "enable"), (HEAD + "rules:\n  term_consistency:\n    glossary_type: g\n    glossry_type: oops\n", 7, "glossry_type"),
        (HEAD + "rules:\n  dep_odrer:\n    enabled: false\n", 5, "dep_odrer"), (HEAD + "rules:\n  dep_order:\n    enabled: 3\n", 6, "true or false"), (HEAD + "rules:\n  dep_order: [1]\n", 5, "mapping"), (HEAD + "rules: 7\n", 4, "mapping"),
        (HEAD + "rules:\n  dep_order:\n    enabled: true\n    enabled: false\n", 7, "twice"), (HEAD.replace("type: req, ", ""), 3, "type"), (HEAD.replace(', id_pattern: "R-{seq}"', ""), 3, "id_pattern"),
        (HEAD.replace("R-{seq}", "R-{seq}.{seq}"), 3, "{seq}"), (HEAD.replace("a.md", "'docs/[.md'"), 3, "docs/[.md"), (HEAD.replace("a.md", "../shared/*.md"), 3, "leads out"), (HEAD.replace("a.md", "/abs/*.md"), 3, "leads out"),
        (HEAD.replace("a.md", "docs/../../x/*.md"), 3, "leads out"), (HEAD.replace("}\n", ", depends_on: [../s/*.md]}\n"), 3, "leads out"), (HEAD.replace("}\n", ", depends_on: ['docs/[.md']}\n"), 3, "docs/[.md"),
        (HEAD + '  - {path: ./x/../a.md, type: req, id_pattern: "S-{seq}"}\n', 4, "twice"), (HEAD.replace("}\n", ", id_levels: [7]}\n"), 3, "1 to 6"), (HEAD.replace("}\n", ", id_start: many}\n"), 3, "whole number"), ("chain: {a: b}\n", 1, "list"), ("chain: [a\nfiles: }\n", 2, ""),
    ],
)
def test_faults_name_their_line(tmp_path, text, line, what):
    with pytest.raises(config.ConfigError) as e:
        load(tmp_path, text)
    assert f"linkgraph.yaml:{line}: " in str(e.value) and what in str(e.value)


def test_merged_rules_and_lenient_reading(tmp_path):
    own = load(tmp_path, HEAD + "defaults: &d\n  enabled: false\nmore: &m {<<: *d, check_sequence: true}\nrules:\n  ref_integrity:\n    <<: *d\n  id_uniqueness:\n    <<: [*m]\n    enabled: true\n  dep_order:\n")
    assert own.rules["ref_integrity"] == {"enabled": False} and own.rules["id_uniqueness"] == {"enabled": True, "check_sequence": True} and own.rules["dep_order"]["enabled"]
    own = load(tmp_path, HEAD + "rules:\n  term_consistency:\n    glossary_type: terms\n  dep_odrer:\n    enabled: false\n", check_rules=False)
    assert own.glossary_type() == "terms" and load(tmp_path, HEAD).glossary_type() == "glossary"
    with pytest.raises(config.ConfigError):
        own.rules  # noqa: B018


def test_allowed_declarations(tmp_path):
    for text in (HEAD.replace("a.md", "../shared/extra.md"), HEAD.replace("a.md", "a/../b/*.md"), HEAD + '  - {path: "*.md", type: req, id_pattern: "S-{seq}"}\n', HEAD.replace("[req]", "[req, req]"), HEAD.replace("a.md", "later/**/*.md")):
        assert load(tmp_path, text).chain


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("docs/*.md", "docs/a.md", "docs/x/a.md"), ("**/a.md", "x/y/a.md", "x/ba.md"), ("d/**/*.md", "d/a.md", "e/a.md"), ("{a,b/c}.md", "b/c.md", "c.md"), ("a?[!0-9].md", "abx.md", "ab1.md"), ("x[ab].md", "xa.md", "xc.md")],
)
def test_globs(pattern, yes, no):
    import re

    assert re.fullmatch(scan.glob_regex(pattern), yes) and not re.fullmatch(scan.glob_regex(pattern), no)


def test_documents_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "ENTRIES", 7)
    text = 'chain: [req]\nfiles:\n  - {path: "docs/**/*.md", type: req, id_pattern: "R-{seq}"}\n  - {path: docs/x/own.md, type: terms, id_pattern: "T-{seq}"}\n  - {path: gone/b.md, type: req, id_pattern: "R-{seq}"}\n'
    for k in range(40):
        folder = tmp_path / "docs" / ("x" if k % 3 else "y/z")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.md").write_bytes(f"## R-{k}: T\r\nR-{k + 1}\r\n".encode())
    (tmp_path / "docs/x/own.md").write_text("## T-1: A\n")
    (tmp_path / "docs/x/other.txt").write_text("no")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/u.md").write_text("See R-3.\n")
    os.symlink(tmp_path / "docs/x/f1.md", tmp_path / "docs/x/zlink.md")
    os.symlink(tmp_path / "docs/x/f2.md", tmp_path / "docs/x/alink.md")
    own = load(tmp_path, text)
    rows = {r.path: r for r in config.open_corpus(spark, own).docs.collect()}
    assert sorted(rows) == config.targets(own) and len(rows) == 41
    assert rows["docs/x/own.md"].type == "terms" and rows["docs/y/z/f3.md"].text == "## R-3: T\r\nR-4\r\n" and "docs/x/alink.md" in rows
    assert [r.path for r in config.open_corpus(spark, own).docs.where("type = 'terms'").collect()] == ["docs/x/own.md"]
    both = {r.path: r.type for r in config.open_corpus(spark, own, ["other", "docs/x/own.md", "docs/y"]).docs.collect()}
    assert both["other/u.md"] is None and both["docs/x/own.md"] == "terms" and len(both) == 2 + 14
    plan = config.open_corpus(spark, own).docs._jdf.queryExecution().toString()
    assert "f1.md" not in plan
    with pytest.raises(config.ConfigError):
        config.open_corpus(spark, own, ["nowhere.md"])


def test_files_in_the_order_of_arguments(tmp_path):
    for f in "abc":
        (tmp_path / f"{f}.md").write_text("")
    own = load(tmp_path, HEAD)
    assert config.in_turn(own, ["c.md", "a.md", "c.md", "."]) == ["c.md", "a.md", "b.md"]
