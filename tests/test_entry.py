"""The driver's entry without the corpus operators, and with one of their imports broken."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def copy(tmp_path):
    shutil.copytree(os.path.join(ROOT, "concordia"), tmp_path / "concordia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_entry_stands_without_the_corpus_operators(tmp_path):
    got = run(copy(tmp_path), "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)")
    assert got.returncode == 0, got.stderr


def test_a_broken_import_is_an_error(tmp_path):
    folder = copy(tmp_path)
    (folder / "concordia/llm").mkdir()
    (folder / "concordia/llm/__init__.py").write_text("")
    (folder / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    got = run(folder, "import __spark_entry__ as e; e.queries()")
    assert got.returncode != 0 and "no_such_module_at_all" in got.stderr
