"""The driver's contract holds with and without the subpackage for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from lectern.plans import catalogue

REPO = Path(__spark_entry__.__file__).parent


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert catalogue.queries().keys() <= __spark_entry__.queries().keys()


def test_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    (tmp_path / "lectern" / "llm" / "__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert set(said.stdout.split()) == set(catalogue.queries())
