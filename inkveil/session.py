"""What every part of the package needs from a Spark session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}
_own_folder: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever they run, and keep Arrow batches small unless the session sets their size."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_ROWS) == "10000":  # the default: rows here are whole texts and files, so a batch would be large on either side
        spark.conf.set(ARROW_ROWS, "1000")
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="inkveil-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "inkveil_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
    context.addPyFile(archive)
    _shipped[context.applicationId] = archive


def as_uri(folder: str) -> str:
    """A folder as a URI: plain paths are those of this machine's file system."""
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own.

    On a cluster without that setting this raises, as no local folder would be seen by the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own_folder:
        made = tempfile.mkdtemp(prefix="inkveil-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(f"file://{made}")
        _own_folder[context.applicationId] = f"file://{made}"
    return _own_folder[context.applicationId]


class Scratch:
    """Tables written to the shared folder and read again: they cut the lineage and outlive executors.

    They are deleted when drop() is called, or when the JVM ends.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/inkveil-{what}-{uuid.uuid4().hex}"
        path, files = self._at(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(self.path(name))
            files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        path, files = self._at(self.root)
        self.drop(*[n for n in (s.getPath().getName() for s in files.listStatus(path)) if n not in names])
