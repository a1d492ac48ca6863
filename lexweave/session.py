"""What a session needs before Python code of the library runs on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Tables of long texts, the work on which is worth a shuffle.
TEXTS = ("documents", "pages")


def ship_package(spark: SparkSession) -> None:
    """Sends the library to the executors' Python workers, once a session; they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="lexweave-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of that name; columns come as they are stored.

    A table of texts in fewer files than half the session's cores would be worked on by so few tasks, as Spark can't
    split a file within a row group. Its rows are dealt out anew.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and len(df.inputFiles()) < cores // 2 else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt out evenly to several tasks a core, for costly work on rows of a small file, which a single task reads."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def settle(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset a temporary folder takes its place on a local master; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
    return df.checkpoint(eager=True)
