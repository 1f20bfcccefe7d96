"""The driver reads the queries in a fresh process, before any session exists."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140; assert set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
