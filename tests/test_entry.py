"""The driver contract without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [("agora/llm", "tests/llm", "corpus_pipeline.py"), ("agora/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_the_rest_works_without(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    n, ops, pipeline = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) > 100 and pipeline == "False" and int(ops) in ((0,) if "agora/llm" in gone else (0, 13))


@pytest.mark.parametrize("absent", ["ahocorasick", "tokenizers", "xxhash"])
def test_the_rest_works_where_a_library_is_absent(absent):
    says = f"import sys; sys.modules[{absent!r}] = None; {SAYS}"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    n, ops, _ = subprocess.run([sys.executable, "-B", "-c", says], cwd=ROOT, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) > 100 and int(ops) in (0, 13)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "agora")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as text:
                        assert "agora.llm" not in text.read(), name
