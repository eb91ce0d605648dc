"""The library without its training-data part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

WITHOUT = """
import sys
sys.modules["ripplework.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as entry
print(len(entry.queries()), any(n.startswith("op") and "_" in n and n[2].isdigit() for n in entry.queries()), "pipeline" in entry.queries(), len(entry.oracle_sql()))
"""


def test_entry_works_without_the_training_data_part():
    out = subprocess.run([sys.executable, "-c", WITHOUT], capture_output=True, text=True, cwd=Path(entry.__file__).parent, check=True)
    n, ops, pipeline, n_sql = out.stdout.split()
    assert (ops, pipeline) == ("False", "False")
    assert int(n) > 150 and int(n_sql) > 140


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
