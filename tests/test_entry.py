import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", ["ahocorasick", "xxhash", "ledgerloom.llm"])
def test_queries_stand_without_what_training_data_needs(gone):
    code = f"""
import sys
sys.modules[{gone!r}] = None
import __spark_entry__ as e
from ledgerloom import catalog
q = e.queries()
assert set(catalog.queries()) <= set(q) and set(e.oracle_sql()) <= set(q)
assert not any(k.startswith("op") and k[2].isdigit() for k in q) and "pipeline" not in q
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
