"""Session helpers: a tuned local session, stable checkpoints, checked broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import FileSystem

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "quern", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where none is set (tests) a temporary folder is used, and only on a local
    master, where every executor shares the machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = _shared_folder(spark)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        context.setCheckpointDir(folder or _temporary("quern-checkpoint-"))
    return df.checkpoint(eager=True)


def _temporary(prefix: str) -> str:
    """A folder of this machine that goes when the driver does."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables written on the way: in the shared checkpoint folder, or on a local master where none is set in a temporary one."""
    folder = _shared_folder(spark) or _temporary("quern-scratch-")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder named in ``spark.checkpoint.dir``, if any."""
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY) or None


def checked_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows.

    The size is measured (a limited count over a lookup table), never assumed;
    beyond the bound the frame comes back unmarked and joins by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application.

    Python workers import the package by name; a cluster that does not have it
    installed gets it as a zip, from the shared checkpoint folder where one is set, else
    through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("quern") / source.relative_to(root))
    folder = _shared_folder(spark)
    if folder is None:
        path = str(Path(_temporary("quern-ship-")) / "quern.zip")
        Path(path).write_bytes(data.getvalue())
    else:
        path = f"{folder.rstrip('/')}/{context.applicationId}/quern.zip"
        FileSystem(spark).write_bytes(path, data.getvalue())
    context.addPyFile(path)
    context._quern_shipped = True
