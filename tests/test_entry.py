"""The entry point with and without the pipeline package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), set(o) <= set(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"


def ask(root):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_registry_stands_without_the_pipeline_package(tmp_path):
    from shelfmark.plans.oracles import ORACLES
    from shelfmark.plans.queries import QUERIES

    for name, keep in (("all", lambda d, names: [n for n in names if n in ("__pycache__", ".git", "tests")]),
                       ("package", lambda d, names: [n for n in names if n in ("__pycache__", ".git", "tests", "llm")]),
                       ("both", lambda d, names: [n for n in names if n in ("__pycache__", ".git", "tests", "llm", "corpus_pipeline.py")])):
        shutil.copytree(ROOT, tmp_path / name, ignore=keep)
    assert ask(tmp_path / "package") == ask(tmp_path / "both") == [str(len(QUERIES)), str(len(ORACLES)), "True", "False", "False"]
    if os.path.isdir(os.path.join(ROOT, "shelfmark", "llm")):
        found = ask(tmp_path / "all")
        assert int(found[0]) > len(QUERIES) and found[2:] == ["True"] * 3
