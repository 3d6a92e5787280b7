"""Python workers that know nothing of the repository's folder."""

import os
import subprocess
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

from riskscope.llm.common import ship
from riskscope.session import ship_package

SCRIPT = """
import sys
sys.path.insert(0, {top!r})
from riskscope.operators import extratrees as ET
from riskscope.session import get_spark
from pyspark.sql import functions as F

spark = get_spark("local[2]", shuffle_partitions=2)
rows = spark.range(40).select(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") > 19).cast("int").alias("label"))
model = ET.fit(rows, 2, n_trees=2, max_depth=3)
p = [r["p"] for r in rows.select(model.probability(F.col("x")).alias("p")).collect()]
assert len(p) == 40 and p[0] < p[39]
print("fitted")
"""


def test_workers_find_the_package_from_any_folder():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(top=top)], cwd=tempfile.mkdtemp(prefix="riskscope-elsewhere-"), env=env, capture_output=True, text=True, timeout=240)
    assert got.returncode == 0 and "fitted" in got.stdout, got.stderr[-2000:]


def test_threads_send_the_package_once(spark, monkeypatch):
    sc = spark.sparkContext
    sent = []

    def slow(path):
        sent.append(path)
        time.sleep(0.3)  # the other threads ask meanwhile

    monkeypatch.setattr(sc, "_riskscope_sent", False, raising=False)
    monkeypatch.setattr(sc, "addPyFile", slow)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda send: send(), [ship_package, lambda: ship(spark)] * 2))
    assert len(sent) == 1
