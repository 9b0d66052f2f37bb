"""The driver's entry without the optional subpackage, or without a library that it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["xxhash", "tidemark.llm", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = entry.queries()
assert "agg1_ctr_by_category" in names and "pipeline" not in names and set(entry.oracle_sql()) <= set(names)
assert {missing == "corpus_pipeline"!r} or not any(n.startswith("op9_") for n in names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
