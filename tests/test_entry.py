"""The entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [[], ["masar/llm", "tests/llm"], ["masar/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_parts(tmp_path, gone):
    to = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in gone:
        if os.path.isdir(to / x):
            shutil.rmtree(to / x)
        elif os.path.exists(to / x):
            os.remove(to / x)
    out = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    many, of_corpus = map(int, out.stdout.split())
    there = os.path.exists(to / "masar/llm")
    assert many > 300 and (of_corpus >= 11 if there and os.path.exists(to / "corpus_pipeline.py") else of_corpus == 0)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "masar")):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "masar.llm" not in text.read(), f
