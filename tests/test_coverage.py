"""Every operator of the inventory is tagged in the code that implements it, and queries and SQL are registered alike."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

import __spark_entry__ as entry

SIZES = {"S": 14, "K": 15, "G": 13, "E": 23, "A": 20, "Q": 13, "N": 16, "J": 18}


def test_every_operator_is_tagged():
    root = pathlib.Path(entry.__file__).parent / "graphloom"
    tags = {t for p in root.rglob("*.py") for t in re.findall(r"# op: ([A-Z]\d+)", p.read_text())}
    missing = [f"{k}{n}" for k, m in SIZES.items() for n in range(1, m + 1) if f"{k}{n}" not in tags]
    assert not missing


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"id", "depth", "degree", "risk"} <= set(df.columns)


def test_the_core_stands_without_the_corpus_operators(tmp_path):
    """Without graphloom/llm, and with or without corpus_pipeline.py, the entry points give the core's queries and SQL."""
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'g_degree' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    pipeline = root / "corpus_pipeline.py"
    for extra in ([], [pipeline] if pipeline.exists() else []):
        for p in extra:
            shutil.copy(p, tmp_path)
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
