"""The package on the workers' path, the folder that driver and executors share, and written work tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of a batch that goes to a Python worker, where the session does not say otherwise: long texts come in few rows.
BATCH, DEFAULT_BATCH = "4m", "67108864b"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers run on one machine, so that they share its folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


#: Application ids to whose workers the package has been sent.
_sent: set[str] = set()


def _send(spark: SparkSession) -> None:
    """Send the package to the executors, present and to come, as a zip file."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    package = os.path.join(ROOT, __package__.split(".")[0])
    folder = tempfile.mkdtemp(prefix="graphloom-package-")  # read by the driver, which serves the file
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "graphloom-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), ROOT))
    spark.sparkContext.addPyFile(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package (its folder on their path on one machine, else a copy sent to them), and bound the bytes of their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if not is_local(spark):
        _send(spark)
        return spark
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the session is local (tests).

    Raises RuntimeError where it is unset on a cluster, whose machines share no local folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Workspace:
    """A folder of written tables below shared_dir; they cut lineage and outlive executors."""

    live: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        Workspace.live.append(self)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/work-{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if SparkContext._active_spark_context is None or self.spark.sparkContext._jsc is None:  # the session has ended
            local = self.path.removeprefix("file://").removeprefix("file:")
            shutil.rmtree(os.path.join(local, name), ignore_errors=True)
            return
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop("")
        if self in Workspace.live:
            Workspace.live.remove(self)
