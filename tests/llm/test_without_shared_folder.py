"""All operators and the pipeline where no configuration names a shared folder: a fresh process with an empty SPARK_CONF_DIR."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from textloom.session import get_spark
spark = get_spark("bare", 8)
assert not spark.conf.get("spark.checkpoint.dir", None)
found = entry.queries()
for name in sorted(found):
    if name == "pipeline" or name.startswith("op") and name[2:3].isdigit():
        assert found[name](spark, "/root/testdata/sf0.001").count() > 0, name
        print("ran", name, flush=True)
spark.stop()
"""


def test_all_run_without_a_shared_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root)], env=env, capture_output=True, text=True, timeout=900)
    assert got.stdout.count("ran ") == 14, got.stdout[-2000:] + got.stderr[-4000:]
