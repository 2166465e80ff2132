"""Queries whose executors are processes of their own, as on any cluster: what is in the driver's memory isn't in theirs."""

import importlib.util
import json
import os
import pathlib
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import json, os, sys
from pyspark.sql import SparkSession
folder, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.createDataFrame([(i, f"c{i}") for i in range(6)], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
spark.createDataFrame([(i, f"s{i}") for i in range(1, 3)], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
spark.createDataFrame([(i, f"n{i}") for i in range(2, 4)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
import __spark_entry__
out = {}
for n in names:
    try:
        out[n] = sorted(map(list, __spark_entry__.queries()[n](spark, folder).collect()))
    except Exception as e:
        out[n] = [str(e)[-500:]]
open(f"{folder}/got.json", "w").write(json.dumps(out))
os._exit(0)
"""
WANT = {
    "delete_rows": [["0", "c0"], ["1", "seen"], ["4", "c4"], ["5", "c5"]],
    "job_entries": [["X", "7"], ["Y", ""], ["aborted", "False"], ["failed command", "False"], ["mail", "h/done/all"], ["no file", "True"], ["result", "True"], ["seen", "6"]],
    "table_round_trip": [[str(i), f"c{i}"] for i in range(6)],
    "insert_update": [["0", "c0"], ["1", "new s1"], ["2", "new s2"], ["3", "c3"], ["4", "c4"], ["5", "c5"], ["x1", "added"]],
}


@pytest.fixture(scope="module")
def got(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cluster")
    (folder / "home/work").mkdir(parents=True)  # the executors' logs go to work in Spark's home
    for p in pathlib.Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (folder / "home" / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(folder / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(folder / "local")}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    subprocess.run([sys.executable, "-c", RUN, str(folder), *WANT], env=env, cwd=folder, timeout=600, capture_output=True)
    return json.loads((folder / "got.json").read_text())


@pytest.mark.parametrize("name", WANT)
def test_databases_of_the_driver(got, name):
    assert got[name] == WANT[name]
