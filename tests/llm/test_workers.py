"""Queries run where only the driver has the package: the workers get its code by value."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
queries = entry.queries()
for name in sys.argv[1:]:
    print("rows", name, queries[name](spark, {FOLDER!r}).count())
"""
NAMES = ["p1_found", "p2_packed", "p3_found", "p4_sample", "p5_found", "p6_mix", "p7_found", "p7_redacted"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_from_an_empty_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, *NAMES], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    counts = {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("rows ")}
    assert set(counts) == set(NAMES), done.stderr[-3000:]
    assert all(n > 0 for n in counts.values())
