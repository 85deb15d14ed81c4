import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
PLAIN = """
import os
from pyspark.sql import SparkSession
from strataspark.session import materialise, release, shared_dir

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
table = materialise(spark.range(5), "five")
assert table.count() == 5 and os.path.isdir(table.scratch_path)
assert table.scratch_path.startswith(shared_dir(spark))
release(table, None, spark.range(1))
assert not os.path.exists(table.scratch_path)
print("fine")
"""


def test_a_plain_session_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    ran = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in ran.stdout, ran.stderr[-2000:]
