import json

import pytest

from linkgraph import cli
from linkgraph.operators import scaffold
from linkgraph.sources import config

YAML = """chain: [req, des]
files:
  - {path: docs/req.md, type: req, id_pattern: "R-{seq}"}
  - {path: "docs/des*.md", type: des, id_pattern: "D-{seq}", depends_on: [docs/req.md]}
"""


@pytest.fixture
def project(tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "linkgraph.yaml").write_text(YAML)
    (tmp_path / "sections.yaml").write_text("req: {required: []}\ndes:\n")
    (tmp_path / "docs/req.md").write_text("# Needs\n\n## R-1: One\nx\n\n## R-2: Two\nx\n")
    (tmp_path / "docs/des.md").write_bytes("# Design\r\n\r\n## D-1: A\r\nR-1\r\n\r\n## New part\r\ny\r\n".encode())
    monkeypatch.chdir(tmp_path)
    return tmp_path


def out(capsys, spark, *argv):
    code = cli.main([*argv], spark)
    return code, capsys.readouterr().out


def test_commands(project, spark, capsys):
    assert out(capsys, spark, "verify")[0] == 0
    code, text = out(capsys, spark, "gaps")
    assert code == 1 and "R-2 missing" in text and "50%" in text
    assert "| R-1 | D-1 |" in out(capsys, spark, "matrix")[1]
    rows = json.loads(out(capsys, spark, "matrix", "--format", "json")[1])["rows"]
    assert [r | {"file": None, "line": 0} for r in rows] == [{"id": "R-1", "title": "One", "file": None, "line": 0, "paths": [["D-1"]], "status": "complete"}, {"id": "R-2", "title": "Two", "file": None, "line": 0, "paths": [], "status": "missing"}]
    assert [(r["file"], r["line"]) for r in rows] == [("docs/req.md", 3), ("docs/req.md", 6)]
    assert "D-1 A" in out(capsys, spark, "impact", "R-1")[1]
    assert "n0 --> n" in out(capsys, spark, "graph")[1].replace("n1 -->", "n0 -->").replace("n2 -->", "n0 -->")
    assert out(capsys, spark, "show", "R-2")[1] == "## R-2: Two\nx\n"
    assert cli.main(["show", "R-9"], spark) == 2 and cli.main(["matrix", "--from", "zzz"], spark) == 2


def test_ids_are_written_with_their_line_ends(project, spark, capsys):
    before = (project / "docs/des.md").read_bytes()
    assert out(capsys, spark, "id", "docs/des.md", "--dry-run") == (0, "docs/des.md:6: D-2\n") and (project / "docs/des.md").read_bytes() == before
    assert out(capsys, spark, "id", "docs/des.md")[0] == 0
    assert (project / "docs/des.md").read_bytes() == before.replace(b"## New part", b"## D-2: New part")


def test_config_errors(project):
    for text in ("chain: []\n", YAML.replace("[req, des]", "[req, zzz]"), YAML.replace("R-{seq}", "R-{seq}{seq}"), YAML + "rules: {nope: {}}\n", YAML + "rules: {dep_order: {colour: 1}}\n"):
        (project / "bad.yaml").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(str(project / "bad.yaml"))
    with pytest.raises(config.ConfigError):
        config.discover(None, str(project / "docs"))


def test_write_all_rolls_back(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("old")
    b.mkdir()
    with pytest.raises(ValueError):
        scaffold.write_all({str(a): "new", str(b): "x"})
    assert a.read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_init_new_and_templates(tmp_path, monkeypatch, spark, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "docs").mkdir()
    assert cli.main(["init", "--preset", "small"], spark) == 0 and cli.main(["init", "--preset", "small"], spark) == 2
    assert cli.main(["init", "--preset", "small", "--force"], spark) == 0
    capsys.readouterr()
    assert out(capsys, spark, "templates")[1] == "specification\ntests\n"
    assert cli.main(["new", "specification", "-o", "docs/specification.md"], spark) == 0
    assert cli.main(["new", "tests", "-o", "docs/tests.md", "--based-on", "docs/specification.md"], spark) == 0
    assert "## V-1: Feature\n\n- S-1\n" in (tmp_path / "docs/tests.md").read_text()
    capsys.readouterr()
    assert "## S-2: More" in out(capsys, spark, "new", "specification", "--feature", "More", "--dry-run")[1]
    assert out(capsys, spark, "gaps")[0] == 0
    assert out(capsys, spark, "list", "--format", "tree")[1].startswith("docs/specification.md\n  S-1")


def test_stream_checks_each_batch(tmp_path, spark):
    from linkgraph.streaming.verify import verify_stream

    schema = "path string, type string, id_pattern string, text string"
    spark.createDataFrame([("a.md", "req", "R-{seq}", "## R-1\nR-9\n")], schema).write.parquet(str(tmp_path / "in"))
    got = []
    stream = verify_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["req"], ["R-{seq}"], lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    assert stream.awaitTermination(60)
    assert [(r.kind, r.line) for r in got] == [("ref_undefined", 2)]
