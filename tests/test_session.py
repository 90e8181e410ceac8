import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quern.session import checked_broadcast, stable_checkpoint

ROOT = Path(__file__).resolve().parent.parent


def test_checked_broadcast_measures(spark):
    small, large = checked_broadcast(spark.range(5), 5), checked_broadcast(spark.range(6), 5)
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(small) and "strategy=broadcast" not in plan(large)


def test_checkpoint_cuts_lineage(spark):
    df = stable_checkpoint(spark.range(10).where(F.col("id") > 3))
    assert df.count() == 6 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_package_and_checkpoints_reach_separate_executors(tmp_path):
    """On executors of their own, from another folder and without the package on their path."""
    conf = {
        "spark.master": "local-cluster[1,1,512]", "spark.executor.memory": "512m", "spark.driver.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1", "spark.local.dir": str(tmp_path / "scratch"), "spark.checkpoint.dir": f"file://{tmp_path}/shared",
    }
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.config(map={conf!r}).getOrCreate()
from quern.operators.nested import flatten_bundles
from quern.session import stable_checkpoint
df = spark.createDataFrame([(1, '{{"predictions": [{{"doc_id": 1}}]}}')], "bundle_id bigint, payload string")
print("ROWS", flatten_bundles(df).count())
print("CHECKPOINTED", stable_checkpoint(flatten_bundles(df)).count())
"""
    env = {
        "PATH": "/usr/bin:/bin:" + str(Path(sys.executable).parent), "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path / "work"),
        "SPARK_LOCAL_DIRS": str(tmp_path / "scratch"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_HOSTNAME": "localhost",
    }
    env |= {k: os.environ[k] for k in ("JAVA_HOME",) if k in os.environ}
    (tmp_path / "scratch").mkdir()
    for _ in range(3):  # the cluster of a loaded machine may fail to start; what runs on it is not tried again
        run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=240, env=env)
        if "_initialize_context" not in run.stderr:
            break
    logs = "".join(p.read_text(errors="replace")[-2000:] for p in (tmp_path / "work").rglob("stderr")) if "ROWS 1" not in run.stdout else ""
    assert "ROWS 1" in run.stdout, run.stderr[:3000] + run.stderr[-3000:] + logs
    assert "CHECKPOINTED 1" in run.stdout and list((tmp_path / "shared").rglob("quern.zip"))
