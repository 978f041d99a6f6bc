"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow.dataset
import pyarrow.fs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting
    wins. Only a local master without one (tests, single machines) gets a
    temporary folder: elsewhere executors could not read each other's files.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop variable with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_order(spark: SparkSession, jobs: Sequence[Callable[[], object]], at_once: int) -> list:
    """Results of independent jobs in their order, ``at_once`` of them running at a time."""
    ensure_checkpoint_dir(spark)  # one folder for all
    if at_once <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        # Each call copies the session's properties.
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [future.result() for future in running]


def read_folder(folder: str) -> pyarrow.dataset.Dataset:
    """Parquet files of a shared folder, read inside a task: a path, or a URI that Arrow opens."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.dataset.dataset(path, filesystem=system, format="parquet")


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the workers of a session, which may not have it on their path.

    Functions that run in Python workers refer to the package's modules by name.
    Spark serves the archive to every executor; once per application is enough.
    """
    sc = spark.sparkContext
    with _shipping:
        if sc.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for module in sorted(root.rglob("*.py")):
                z.write(module, module.relative_to(root.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
