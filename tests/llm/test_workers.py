"""Queries with Python workers run where the executors have no copy of the repository."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = "op1_quality_classifier op2_media_columns op3_minhash_near_dedup op7_packing op8_mixing op10_suffix_array_dedup op11_embedding_whitening op13_conversation_prefix_trie".split()


def run_elsewhere(names, tmp_path, import_line):
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
{import_line}
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name in {names!r}:
    print("ROWS", name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
""")
    away = tmp_path / "away"
    away.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(["timeout", "400", sys.executable, str(script)], capture_output=True, text=True, cwd=away, env=env)
    rows = {x.split()[1]: int(x.split()[2]) for x in done.stdout.splitlines() if x.startswith("ROWS")}
    assert set(rows) == set(names) and min(rows.values()) > 0, done.stderr[-2000:]


def test_operators_travel_by_value(tmp_path):
    run_elsewhere(NAMES, tmp_path, "from lodestar.llm.queries import QUERIES")
