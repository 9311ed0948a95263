"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tidemark.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'pipeline' not in names and 'q_markout_30' in names; e.oracle_sql(); print(len(names))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_no_module_outside_names_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/tidemark"):
        if "llm" not in folder.split(os.sep):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "tidemark.llm" not in f.read(), name
