"""Executors without a copy of the repository: only the driver's process finds the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.range(10).mapInArrow(lambda batches: batches, "id long").count()  # workers start before the driver finds the package
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
def missing(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("tracemill") is not None]})
assert not any(r.found for r in spark.range(4).mapInArrow(missing, "found boolean").collect())
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


def test_all_corpus_queries(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = Path(__file__).resolve().parents[2]
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(root), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) >= 12
