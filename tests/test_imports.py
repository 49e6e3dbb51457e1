import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
EVERY = """
import importlib, pkgutil, keepsake
for m in pkgutil.walk_packages(keepsake.__path__, "keepsake."):
    importlib.import_module(m.name)
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()) and e.queries()
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
print("imported")
"""


def test_everything_imports_and_lists_its_queries_without_a_session():
    run = subprocess.run([sys.executable, "-c", EVERY], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("imported"), run.stderr[-2000:]
