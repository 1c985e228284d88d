"""The registry holds without the parts that may be taken out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": folder})
    return [set(line.split()) for line in done.stdout.splitlines()]


def test_core_queries_stay_when_the_training_data_part_is_gone(tmp_path):
    from linkgraph.plans import catalog

    bare = str(tmp_path / "bare")
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    assert names(bare) == [set(catalog.queries()), set(catalog.oracle_sql())]
    with_pipeline = str(tmp_path / "with_pipeline")
    shutil.copytree(bare, with_pipeline)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", with_pipeline)
    assert names(with_pipeline) == [set(catalog.queries()), set(catalog.oracle_sql())]


def test_a_faulty_import_is_not_taken_for_absence(tmp_path):
    if not os.path.isdir(f"{ROOT}/linkgraph/llm"):
        return
    broken = str(tmp_path / "broken")
    shutil.copytree(ROOT, broken, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    with open(f"{broken}/linkgraph/llm/queries.py", "a") as f:
        f.write("\nimport no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=broken, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": broken})
    assert done.returncode and "no_such_module" in done.stderr
