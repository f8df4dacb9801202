"""The entry point without the text package, and the scratch folder of a session that names none."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT_TEXT = """
import sys
sys.modules["limpid.llm"] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
assert "audit_table" in names and "pipeline" not in names
assert not [n for n in names if n.startswith("op") and n[2].isdigit()]
"""

PLAIN_SESSION = """
from pyspark.sql import SparkSession
from limpid.storage import materialised, scratch_dir
spark = (
    SparkSession.builder.master("local").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate()
)
assert materialised(spark.range(5), "five").count() == 5
assert scratch_dir(spark) == scratch_dir(spark)
"""


def _run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_the_rest_stands_without_the_text_package():
    _run(WITHOUT_TEXT)


def test_a_session_that_names_no_scratch_folder():
    _run(PLAIN_SESSION)
