"""The driver imports __spark_entry__ from elsewhere, with its own plain session.

Python UDFs of the package must still import on the executors (the package is
shipped with addPyFile), and no setting of ``get_session`` may be required.
"""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
df = E.entry(spark)
rows = df.collect()
assert len(rows) > 0 and df.columns == ["split", "domain", "acc", "n"], df.columns
n = E.queries()["top_k_per_class"](spark, "/root/testdata/sf0.001").count()
assert n > 0
print("PLAIN-OK", len(rows), n)
"""


def test_entry_in_plain_session_from_other_cwd():
    cwd = tempfile.mkdtemp(prefix="shiftlab-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "PLAIN-OK" in out.stdout, out.stderr[-3000:]
