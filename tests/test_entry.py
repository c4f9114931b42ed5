"""The entry points without the optional subpackage, and without anything else that is needed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy(tmp_path, *left_out):
    target = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "reelgrid"), target / "reelgrid", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), target)
    return target


def names(folder, before=""):
    code = before + "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_queries_without_the_subpackage(tmp_path):
    done = names(copy(tmp_path, "llm"))
    assert done.returncode == 0, done.stderr
    queries, sql = (set(line.split()) for line in done.stdout.splitlines())
    assert len(queries) >= 100 and sql <= queries
    assert "pipeline" not in queries and not any(q.startswith("op") and q[2:3].isdigit() for q in queries)


def test_queries_without_a_library_of_the_subpackage(tmp_path):
    target = copy(tmp_path)
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), target)
    done = names(target, "import sys; sys.modules['ahocorasick'] = None; ")
    assert done.returncode == 0, done.stderr
    assert len(done.stdout.splitlines()[0].split()) >= 100


def test_other_missing_modules_are_errors(tmp_path):
    folder = copy(tmp_path, "llm")
    (folder / "reelgrid" / "adapters.py").unlink()
    assert names(folder).returncode != 0
