"""The library stands without the optional package: a copy that lacks it
still imports and lists every other query."""

import json
import os
import shutil
import subprocess
import sys

from conftest import ROOT

SCRIPT = "import json, __spark_entry__ as E; print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))"


def test_entry_imports_without_the_optional_package(tmp_path):
    from lectern.plans import catalog
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    assert not os.path.exists(copy / "lectern" / "llm")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    queries, oracles = json.loads(out.stdout.splitlines()[-1])
    assert queries == sorted(catalog.QUERIES) and oracles == sorted(catalog.ORACLES)


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "lectern")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as src:
                    assert "llm" not in src.read(), f
